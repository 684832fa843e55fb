"""Encoded samples: token ids and labels that belong together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ASSISTANT, BOS, END, END_THINK, END_TOOL, EOS, IGNORE, SYSTEM, THINK, TOOL_CALL, TOOL_RESULT, USER
from ..functions.text import strip
from ..functions.tokens import stub_ids

Encoder = Callable[[Column], Column]


def _fill(ids: Column, value: int = IGNORE) -> Column:
    return F.transform(ids, lambda _: F.lit(value))


def encode_segments(segments: Column, limit: int, encode: Encoder = stub_ids, bos: bool = True) -> tuple[Column, Column]:
    """(input_ids, labels): segments are encoded one by one, every target is closed by an end token that is a target too."""
    ids = F.flatten(F.transform(segments, lambda s: F.when(s["is_target"], F.concat(encode(s["text"]), F.array(F.lit(EOS)))).otherwise(encode(s["text"]))))
    labels = F.flatten(F.transform(segments, lambda s: F.when(s["is_target"], F.concat(encode(s["text"]), F.array(F.lit(EOS)))).otherwise(_fill(encode(s["text"])))))
    if bos:
        ids, labels = F.concat(F.array(F.lit(BOS)), ids), F.concat(F.array(F.lit(IGNORE)), labels)
    return F.slice(ids, 1, limit), F.slice(labels, 1, limit)


def control_example(messages: Column, limit: int, encode: Encoder = stub_ids, train_thinking: bool = True, fields: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(input_ids, labels) with control tokens around every turn; tool results are context, never targets.

    Messages have role and content; ``fields`` says which of thinking and
    tool_call (JSON text) the struct has besides.  A tool call is a target,
    thinking only if ``train_thinking``.  Null content counts as empty, and
    null or blank thinking and tool calls leave no tokens.
    """

    def piece(head: int | None, text: Column, tail: int | None) -> Column:
        return F.concat(*([F.array(F.lit(head))] if head is not None else []), encode(strip(F.coalesce(text, F.lit("")))), *([F.array(F.lit(tail))] if tail is not None else []))

    def turn(label: bool):
        def build(m: Column) -> Column:
            keep = (lambda ids, target: ids if target else _fill(ids)) if label else (lambda ids, target: ids)
            said = m["content"]
            parts = [keep(F.array(F.lit(ASSISTANT)), False)]
            for name, head, tail, target in (("thinking", THINK, END_THINK, train_thinking), ("tool_call", TOOL_CALL, END_TOOL, True)):
                if name in fields:
                    parts.append(F.when(F.coalesce(strip(m[name]), F.lit("")) != "", keep(piece(head, m[name], tail), target)).otherwise(F.array().cast("array<int>")))
            parts.append(keep(piece(None, said, END), True))
            return (
                F.when(m["role"] == "system", keep(piece(SYSTEM, said, END), False))
                .when(m["role"] == "user", keep(piece(USER, said, END), False))
                .when(m["role"] == "tool", keep(piece(TOOL_RESULT, said, END_TOOL), False))
                .when(m["role"] == "assistant", F.concat(*parts))
                .otherwise(F.array().cast("array<int>"))
            )

        return build

    ids = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(messages, turn(False))), F.array(F.lit(EOS)))
    labels = F.concat(F.array(F.lit(IGNORE)), F.flatten(F.transform(messages, turn(True))), F.array(F.lit(EOS)))
    return F.slice(ids, 1, limit), F.slice(labels, 1, limit)


def alpaca_messages(instruction: Column, extra: Column, output: Column) -> Column:
    """A sample as user and assistant messages; null if instruction or output is blank."""
    i, x, o = (strip(F.coalesce(c, F.lit(""))) for c in (instruction, extra, output))
    asked = F.when(x != "", F.concat(i, F.lit("\n\n"), x)).otherwise(i)
    pair = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), o.alias("content")))
    return F.when((i != "") & (o != ""), pair)


def chat_prompt(ids: Column) -> Column:
    """What a model is asked with: begin, user, ids, end, assistant."""
    return F.concat(F.array(F.lit(BOS), F.lit(USER)), ids, F.array(F.lit(END), F.lit(ASSISTANT)))


def keep_last(context: Column, continuation: Column, limit: int) -> Column:
    """Context and continuation together, the last ``limit`` tokens of them."""
    both = F.concat(context, continuation)
    return F.slice(both, F.greatest(F.size(both) - limit + 1, F.lit(1)), limit)


def trim_context(context: Column, continuation: Column, limit: int) -> Column:
    """The last tokens of the context that leave room for the continuation; fails if it alone fills the limit."""
    room = F.lit(limit) - F.size(continuation)
    checked = F.when(room <= 0, F.raise_error(F.lit("the continuation fills the context")).cast("int")).otherwise(room)
    return F.slice(context, F.greatest(F.size(context) - checked + 1, F.lit(1)), checked)
