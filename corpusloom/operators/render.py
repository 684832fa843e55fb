"""Samples as ordered segments of text, each a training target or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ASSISTANT_HEAD, GAP, INPUT_HEAD, INSTRUCTION_HEAD, LATER_SYSTEM_HEAD, RESPONSE_HEAD, SYSTEM_HEAD, USER_HEAD
from ..functions.text import strip

_NONE = "array<struct<text:string,is_target:boolean>>"


def _segment(text: Column, target: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(target).alias("is_target"))


def _clean(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def alpaca_segments(instruction: Column, extra: Column, output: Column, response: bool = True) -> Column:
    """Masked prompt, then the output; the input part only if it isn't blank."""
    prompt = F.concat(F.lit(INSTRUCTION_HEAD), _clean(instruction), F.when(_clean(extra) != "", F.concat(F.lit(INPUT_HEAD), _clean(extra))).otherwise(""), F.lit(RESPONSE_HEAD))
    return F.array(_segment(prompt, False), *([_segment(_clean(output), True)] if response else []))


def conversation_segments(messages: Column, final_response: bool = True, template: bool = False) -> Column:
    """Segments of a conversation; assistant bodies are targets.

    Normal form: a user turn that no assistant turn follows gets an assistant
    head.  ``template`` form: it gets none, later system turns look like the
    first, and a first segment is there even if empty.  Without
    ``final_response`` the body of an assistant turn that closes the
    conversation after a user turn is left out.
    """
    opens = F.coalesce(F.element_at(messages, 1)["role"] == "system", F.lit(False))
    body = F.when(opens, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    text = _clean(F.element_at(messages, 1)["content"])
    head = F.concat(F.lit(SYSTEM_HEAD), text, F.lit(GAP))
    if template:
        first = F.array(_segment(F.when(opens & (text != ""), head).otherwise(""), False))
    else:
        first = F.when(opens & (text != ""), F.array(_segment(head, False))).otherwise(F.array().cast(_NONE))

    def turn(m: Column, i: Column) -> Column:
        said = _clean(m["content"])
        after = F.when(i + 1 < F.size(body), F.element_at(body, i + 2)["role"])
        before = F.when(i > 0, F.element_at(body, i)["role"])
        answered = F.coalesce(after == "assistant", F.lit(False))
        user = _segment(F.concat(F.lit(USER_HEAD), said, F.lit(GAP)), False)
        cue = _segment(F.lit(ASSISTANT_HEAD), False)
        asked = F.array(user) if template else F.when(answered, F.array(user)).otherwise(F.array(user, cue))
        replied = F.array(cue, _segment(said, True), _segment(F.lit(GAP), False))
        if not final_response:
            closing = (i + 1 == F.size(body)) & F.coalesce(before == "user", F.lit(False))
            replied = F.when(closing, F.array(cue)).otherwise(replied)
        other = F.array(_segment(F.concat(F.lit(SYSTEM_HEAD if template else LATER_SYSTEM_HEAD), said, F.lit(GAP)), False))
        return F.when(m["role"] == "user", asked).when(m["role"] == "assistant", replied).otherwise(other)

    return F.when(messages.isNull() | (F.size(messages) == 0), first if template else F.array().cast(_NONE)).otherwise(F.concat(first, F.flatten(F.transform(body, turn))))


def with_offsets(segments: Column) -> Column:
    """Segments with char_start and char_end in the text they form."""
    state = F.aggregate(
        segments,
        F.struct(F.array().cast("array<struct<text:string,is_target:boolean,char_start:int,char_end:int>>").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.array(F.struct(x["text"].alias("text"), x["is_target"].alias("is_target"), s["at"].alias("char_start"), (s["at"] + F.length(x["text"])).alias("char_end")))).alias("out"),
            (s["at"] + F.length(x["text"])).alias("at"),
        ),
    )
    return state["out"]


def target_spans(placed: Column) -> Column:
    """(start, end) of the targets among segments with offsets."""
    return F.transform(F.filter(placed, lambda s: s["is_target"]), lambda s: F.struct(s["char_start"].alias("start"), s["char_end"].alias("end")))


def rendered(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")
