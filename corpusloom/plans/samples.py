"""Queries over instruction samples, conversations and mask reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GAP, PAD
from ..functions.text import strip
from ..functions.tokens import stub_ids
from ..operators import encode, layout, quality, render, stats
from ..sources import lines as line_sources
from .common import ALPACA, CHATS, VALID_CHAT, WS, alpaca, chats, digest, sql_digest, table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_LIMIT = 512


def _sample_lines(spark, sf) -> DataFrame:
    """All samples of both forms as lines, with comments, blanks and broken lines beside them."""
    a = alpaca(spark, sf).select("sample_id", F.to_json(F.struct("instruction", "input", "output")).alias("line"))
    c = chats(spark, sf).select("sample_id", F.to_json(F.struct("messages")).alias("line"))
    other = F.when(F.col("sample_id") % 29 == 0, "# note").when(F.col("sample_id") % 29 == 1, " ").when(F.col("sample_id") % 29 == 2, "{bad")
    lines = a.unionByName(c)
    return lines.unionByName(lines.select("sample_id", other.alias("line")).where("line is not null"))


_USABLE_CHAT = "(messages is not null and len(messages) > 0 and len(list_filter(messages, lambda m: m.role is null or m.content is null)) = 0)"
_SCANNED = f"""(select sample_id, 'alpaca' as format, length(trim(output, {WS})) as n from {ALPACA} where instruction is not null and output is not null
 union all select sample_id, 'conversation', len(messages) from {CHATS} where {_USABLE_CHAT})"""


@query("s05_sample_scan", f"select format, count(*) as n, sum(n)::bigint as total from {_SCANNED} group by 1")
def s05(spark, sf):
    got = line_sources.samples(_sample_lines(spark, sf), "sample_id")
    return got.groupBy("format").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("output"), F.size("messages"))).cast("long").alias("total"))


@query("s05_first_samples", f"select sample_id, format from {_SCANNED} order by sample_id limit 500")
def s05_first(spark, sf):
    return line_sources.samples(_sample_lines(spark, sf), "sample_id", 500).select("sample_id", "format")


Q["l03_caps"], SQL["l03_caps"] = Q["s05_first_samples"], SQL["s05_first_samples"]


@query("s06_skipped_lines", f"""select (select count(*) + count(*) filter (sample_id % 29 in (0, 2)) from (select sample_id from {ALPACA} union all select sample_id from {CHATS})) - (select count(*) from {_SCANNED}) as n_skipped, (select count(*) from {_SCANNED}) as n_usable""")
def s06(spark, sf):
    lines = _sample_lines(spark, sf)
    usable = line_sources.samples(lines, "sample_id").agg(F.count("*").alias("n_usable"))
    return lines.where(strip("line") != "").agg(F.count("*").alias("n")).crossJoin(usable).select((F.col("n") - F.col("n_usable")).alias("n_skipped"), "n_usable")


@query("pf03_normalised", f"""select sample_id, md5(concat_ws('|', trim(instruction, {WS}), trim(coalesce(input, ''), {WS}), trim(output, {WS}))) as digest from {ALPACA} where instruction is not null and output is not null""")
def p03(spark, sf):
    got = line_sources.samples(_sample_lines(spark, sf), "sample_id").where("format = 'alpaca'")
    return got.select("sample_id", F.md5(F.concat_ws("|", "instruction", "input", "output")).alias("digest"))


@query("pf04_formats", f"select count(*) as total, count(*) filter (format = 'alpaca') as alpaca, count(*) filter (format = 'conversation') as conversation from {_SCANNED}")
def p04(spark, sf):
    return line_sources.samples(_sample_lines(spark, sf), "sample_id").agg(F.count("*").alias("total"), F.count_if(F.col("format") == "alpaca").alias("alpaca"), F.count_if(F.col("format") == "conversation").alias("conversation"))


Q["a05_format_counts"], SQL["a05_format_counts"] = Q["pf04_formats"], SQL["pf04_formats"]
Q["u05_mixed_formats"], SQL["u05_mixed_formats"] = Q["pf04_formats"], SQL["pf04_formats"]

_BLANK = lambda c: f"coalesce(trim({c}, {WS}) = '', true)"


@query("pf05_alpaca_errors", f"""select sample_id, (case when {_BLANK('instruction')} then 1 else 0 end + case when {_BLANK('output')} then 1 else 0 end)::bigint as n_errors,
 (not {_BLANK('instruction')} and not {_BLANK('output')}) as valid, (coalesce(length(output), 0) > 32000) as long_output from {ALPACA}""")
def p05(spark, sf):
    out = quality.validate(alpaca(spark, sf), quality.alpaca_errors(F.col("instruction"), F.col("input"), F.col("output")))
    warned = F.array_contains(quality.long_fields(instruction=F.col("instruction"), input=F.col("input"), output=F.col("output")), "output")
    return out.select("sample_id", F.size("errors").cast("long").alias("n_errors"), "valid", warned.alias("long_output"))


_CHAT_ERRORS = f"""(case when messages is null or len(messages) = 0 then 1 else len(list_filter(messages, lambda m: coalesce(m.role not in ('system','user','assistant'), true)))
 + len(list_filter(messages, lambda m: coalesce(trim(m.content, {WS}) = '', true))) + (case when len(list_filter(messages, lambda m: m.role = 'user')) = 0 then 1 else 0 end) + (case when len(list_filter(messages, lambda m: m.role = 'assistant')) = 0 then 1 else 0 end) end)"""


@query("pf06_conversation_errors", f"select sample_id, {_CHAT_ERRORS}::bigint as n_errors, {_CHAT_ERRORS} = 0 as valid from {CHATS}")
def p06(spark, sf):
    return quality.validate(_deliveries(spark, sf), quality.conversation_errors(F.col("messages"))).select("sample_id", F.size("errors").cast("long").alias("n_errors"), "valid").distinct()


@query("pf07_lenient", f"select sample_id from {CHATS} where {_CHAT_ERRORS} = 0")
def p07(spark, sf):
    return _valid_chats(spark, sf).select("sample_id").distinct()


@query("a10_validation_report", f"""with v as (select sample_id, {_CHAT_ERRORS} = 0 as ok from {CHATS}) select count(*) as total, count(*) filter (ok) as valid, count(*) filter (not ok) as invalid,
 round(count(*) filter (not ok) * 100.0::double / count(*), 6) as dropped_pct, min(sample_id) filter (not ok) as first_dropped from v""")
def a10(spark, sf):
    out = quality.validation_report(quality.validate(chats(spark, sf), quality.conversation_errors(F.col("messages"))), "sample_id")
    return out.withColumn("dropped_pct", F.round(F.col("dropped_pct").cast("double"), 6))


@query("a10_dropped", f"select sample_id, messages is null or len(messages) = 0 as no_messages from {CHATS} where {_CHAT_ERRORS} > 0")
def a10_dropped(spark, sf):
    """The dropped samples, a row each."""
    out = quality.dropped_indices(quality.validate(chats(spark, sf), quality.conversation_errors(F.col("messages"))), "sample_id")
    return out.select("sample_id", (F.col("first_error") == "messages missing or empty").alias("no_messages"))


def _deliveries(spark, sf) -> DataFrame:
    """Every delivery of a conversation. Repeated ones give equal rows, so results are made distinct, not the conversations."""
    return table(spark, sf, "chat_samples").select("sample_id", "messages")


def _valid_chats(spark, sf) -> DataFrame:
    return quality.validate(_deliveries(spark, sf), quality.conversation_errors(F.col("messages"))).where("valid").select("sample_id", "messages")


def _valid_alpaca(spark, sf) -> DataFrame:
    return quality.validate(alpaca(spark, sf), quality.alpaca_errors(F.col("instruction"), F.col("input"), F.col("output"))).where("valid")


_NL = "chr(10)"
_VALID_ALPACA = f"(select * from {ALPACA} where not {_BLANK('instruction')} and not {_BLANK('output')})"
_PROMPT = f"""('### Instruction:' || {_NL} || trim(instruction, {WS}) || case when {_BLANK('input')} then '' else {_NL} || {_NL} || '### Input:' || {_NL} || trim(input, {WS}) end || {_NL} || {_NL} || '### Response:' || {_NL})"""


@query("c01_alpaca_segments", f"select sample_id, md5({_PROMPT}) as prompt, md5(trim(output, {WS})) as target, 2::bigint as n_segments from {_VALID_ALPACA}")
def c01(spark, sf):
    s = _valid_alpaca(spark, sf).select("sample_id", render.alpaca_segments(F.col("instruction"), F.col("input"), F.col("output")).alias("s"))
    return s.select("sample_id", F.md5(F.col("s")[0]["text"]).alias("prompt"), F.md5(F.col("s")[1]["text"]).alias("target"), F.size("s").cast("long").alias("n_segments"))


# every turn of the valid conversations, without a leading system turn, and that turn's text
_TURNS = f"""(select sample_id, i, b[i].role as role, trim(b[i].content, {WS}) as said, b[i + 1].role as after, case when i > 1 then b[i - 1].role end as before, len(b) as n, head from
 (select sample_id, b, head, unnest(range(1, len(b) + 1)) as i from (select sample_id, case when messages[1].role = 'system' then messages[2:] else messages end as b,
 case when messages[1].role = 'system' then trim(messages[1].content, {WS}) else '' end as head from {CHATS} where {VALID_CHAT})))"""
_G = f"{_NL} || {_NL}"


def _turn_text(template: bool, final: bool = True) -> str:
    cue = f"'### Assistant:' || {_NL}"
    dangling = "''" if template else f"case when after = 'assistant' then '' else {cue} end"
    other = f"'System: ' || said || {_G}" if template else f"'### System:' || {_NL} || said || {_G}"
    answer = f"{cue} || said || {_G}"
    if not final:
        answer = f"case when i = n and coalesce(before = 'user', false) then {cue} else {answer} end"
    return f"case role when 'user' then '### User:' || {_NL} || said || {_G} || {dangling} when 'assistant' then {answer} else {other} end"


def _turn_count(template: bool) -> str:
    return "case role when 'user' then " + ("1" if template else "case when after = 'assistant' then 1 else 2 end") + " when 'assistant' then 3 else 1 end"


def _rendered_sql(template: bool, final: bool = True) -> str:
    head = f"case when any_value(head) = '' then '' else 'System: ' || any_value(head) || {_G} end"
    first = "1" if template else "case when any_value(head) = '' then 0 else 1 end"
    return f"""select sample_id, md5({head} || string_agg({_turn_text(template, final)}, '' order by i)) as text, (sum({_turn_count(template)}) + {first})::bigint as n_segments,
 sum(case when role = 'assistant' then length(said) else 0 end)::bigint as n_target_chars from {_TURNS} group by 1"""


def _rendered(spark, sf, template: bool) -> DataFrame:
    s = _valid_chats(spark, sf).select("sample_id", render.conversation_segments(F.col("messages"), template=template).alias("s"))
    chars = F.aggregate(F.filter("s", lambda x: x["is_target"]), F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return s.select("sample_id", F.md5(render.rendered(F.col("s"))).alias("text"), F.size("s").cast("long").alias("n_segments"), chars.alias("n_target_chars")).distinct()


@query("c02_conversation_segments", _rendered_sql(False))
def c02(spark, sf):
    return _rendered(spark, sf, False)


@query("c03_template", _rendered_sql(True))
def c03(spark, sf):
    return _rendered(spark, sf, True)


Q["w05_turn_pairs"], SQL["w05_turn_pairs"] = Q["c02_conversation_segments"], SQL["c02_conversation_segments"]


@query("c04_spans", f"""with t as (select sample_id, i, role, said, length({_turn_text(True)}) as len, length(case when head = '' then '' else 'System: ' || head || {_G} end) as first from {_TURNS}),
 o as (select *, first + coalesce(sum(len) over (partition by sample_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from t)
 select sample_id, count(*) as n_spans, md5(string_agg((pos + 15)::bigint || '-' || (pos + 15 + length(said))::bigint, ',' order by i)) as spans from o where role = 'assistant' group by 1""")
def c04(spark, sf):
    s = _valid_chats(spark, sf).select("sample_id", render.target_spans(render.with_offsets(render.conversation_segments(F.col("messages"), template=True))).alias("t"))
    return s.select("sample_id", F.size("t").cast("long").alias("n_spans"), F.md5(F.array_join(F.transform("t", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")).alias("spans")).distinct()


Q["w06_char_offsets"], SQL["w06_char_offsets"] = Q["c04_spans"], SQL["c04_spans"]


@query("c05_inference_prompt", f"""select sample_id, md5(case when any_value(head) = '' then '' else 'System: ' || any_value(head) || {_G} end || string_agg({_turn_text(False, False)}, '' order by i)) as text from {_TURNS} group by 1""")
def c05(spark, sf):
    return _valid_chats(spark, sf).select("sample_id", F.md5(render.rendered(render.conversation_segments(F.col("messages"), final_response=False))).alias("text")).distinct()


_IDS = lambda t: f"list_transform(string_split({t}, ''), lambda c: unicode(c) % 500 + 3)"


def _control_sql() -> str:
    ids = f"""case role when 'system' then list_concat([4], {_IDS('said')}, [7]) when 'user' then list_concat([5], {_IDS('said')}, [7]) when 'tool' then list_concat([12], {_IDS('said')}, [13])
 when 'assistant' then list_concat([6], {_IDS('said')}, [7]) end"""
    labels = f"""case role when 'assistant' then list_concat([-100], {_IDS('said')}, [7]) else list_transform({_IDS('said')}, lambda c: -100) || [-100, -100] end"""
    return f"""with m as (select sample_id, unnest(messages) as m, unnest(range(1, len(messages) + 1)) as i from {CHATS} where {VALID_CHAT}),
 t as (select sample_id, i, m.role as role, trim(m.content, {WS}) as said from m),
 e as (select sample_id, i, {ids} as ids, {labels} as labels from t),
 g as (select sample_id, list_concat([2], flatten(list(ids order by i)), [3])[1:{_LIMIT}] as ids, list_concat([-100], flatten(list(labels order by i)), [3])[1:{_LIMIT}] as labels from e group by 1)"""


@query("c06_control_tokens", _control_sql() + f" select sample_id, {sql_digest('ids')} as ids, {sql_digest('labels')} as labels from g")
def c06(spark, sf):
    ids, labels = encode.control_example(F.col("messages"), _LIMIT)
    return _valid_chats(spark, sf).select("sample_id", ids.alias("i"), labels.alias("l")).select("sample_id", digest(F.col("i")).alias("ids"), digest(F.col("l")).alias("labels")).distinct()


def _thinking_sql(train: bool) -> str:
    think = f"list_concat([8], {_IDS('thinking')}, [9])"
    call = f"list_concat([11], {_IDS('tool_call')}, [13])"
    none = "[]::bigint[]"
    ignored = lambda x: f"list_transform({x}, lambda c: -100)"
    part = lambda c, x, target: f"case when {c} is null then {none} else {x if target else ignored(x)} end"
    ids = f"""case role when 'system' then list_concat([4], {_IDS('said')}, [7]) when 'user' then list_concat([5], {_IDS('said')}, [7])
 when 'assistant' then list_concat([6], {part('thinking', think, True)}, {part('tool_call', call, True)}, {_IDS('said')}, [7]) end"""
    labels = f"""case role when 'assistant' then list_concat([-100], {part('thinking', think, train)}, {part('tool_call', call, True)}, {_IDS('said')}, [7]) else list_transform({_IDS('said')}, lambda c: -100) || [-100, -100] end"""
    return f"""with m as (select sample_id, unnest(messages) as m, unnest(range(1, len(messages) + 1)) as i from {CHATS} where {VALID_CHAT}),
 t as (select sample_id, i, m.role as role, trim(m.content, {WS}) as said, case when sample_id % 2 = 0 then 'step ' || m.role end as thinking, case when i % 3 = 0 then '{{"name":"find"}}' end as tool_call from m),
 e as (select sample_id, i, {ids} as ids, {labels} as labels from t),
 g as (select sample_id, list_concat([2], flatten(list(ids order by i)), [3])[1:{_LIMIT}] as ids, list_concat([-100], flatten(list(labels order by i)), [3])[1:{_LIMIT}] as labels from e group by 1)
 select sample_id, {sql_digest('ids')} as ids, {sql_digest('labels')} as labels from g"""


def _thinking(spark, sf, train: bool) -> DataFrame:
    think = F.when(F.col("sample_id") % 2 == 0, F.lit("step "))
    rich = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.concat(think, m["role"]).alias("thinking"), F.when((i + 1) % 3 == 0, '{"name":"find"}').alias("tool_call")))
    ids, labels = encode.control_example(F.col("rich"), _LIMIT, train_thinking=train, fields=("thinking", "tool_call"))
    rows = _valid_chats(spark, sf).select("sample_id", rich.alias("rich")).select("sample_id", ids.alias("i"), labels.alias("l"))
    return rows.select("sample_id", digest(F.col("i")).alias("ids"), digest(F.col("l")).alias("labels")).distinct()


@query("c06_thinking_targets", _thinking_sql(True))
def c06_thinking(spark, sf):
    """Thinking and tool calls are targets."""
    return _thinking(spark, sf, True)


@query("c06_thinking_context", _thinking_sql(False))
def c06_context(spark, sf):
    """Tool calls are targets, thinking is context."""
    return _thinking(spark, sf, False)


@query("pf09_drop_rules", f"select sample_id from {ALPACA} where not {_BLANK('instruction')} and not {_BLANK('output')}")
def p09(spark, sf):
    m = encode.alpaca_messages(F.col("instruction"), F.col("input"), F.col("output"))
    kept = alpaca(spark, sf).select("sample_id", m.alias("messages")).where("messages is not null")
    _, labels = encode.control_example(F.col("messages"), 1 << 20)
    return kept.where(quality.trainable(labels)).select("sample_id")


@query("c07_chat_prompt", f"select sample_id, {sql_digest('list_concat([2, 5], ' + _IDS('trim(instruction, ' + WS + ')') + ', [7, 6])')} as ids from {_VALID_ALPACA}")
def c07(spark, sf):
    return _valid_alpaca(spark, sf).select("sample_id", digest(encode.chat_prompt(stub_ids(strip("instruction")))).alias("ids"))


_ENCODED = f"""(select sample_id, list_concat([2], {_IDS('p')}, {_IDS('o')}, [3])[1:{_LIMIT}] as ids, list_concat([-100], list_transform({_IDS('p')}, lambda c: -100), {_IDS('o')}, [3])[1:{_LIMIT}] as labels
 from (select sample_id, {_PROMPT} as p, trim(output, {WS}) as o from {_VALID_ALPACA}))"""


def _encoded(spark, sf) -> DataFrame:
    s = _valid_alpaca(spark, sf).select("sample_id", render.alpaca_segments(F.col("instruction"), F.col("input"), F.col("output")).alias("s"))
    ids, labels = encode.encode_segments(F.col("s"), _LIMIT)
    return s.select("sample_id", ids.alias("input_ids"), labels.alias("labels"))


@query("t10_encoded", f"select sample_id, {sql_digest('ids')} as ids, {sql_digest('labels')} as labels from {_ENCODED}")
def t10(spark, sf):
    return _encoded(spark, sf).select("sample_id", digest(F.col("input_ids")).alias("ids"), digest(F.col("labels")).alias("labels"))


@query("pf08_trainable", f"select sample_id from {_ENCODED} where len(list_filter(labels, lambda x: x <> -100)) > 0")
def p08(spark, sf):
    return _encoded(spark, sf).where(quality.trainable(F.col("labels"))).select("sample_id")


_BATCHED = f"(select sample_id, sample_id // 16 as b, ids, labels, max(len(ids)) over (partition by sample_id // 16) as w from {_ENCODED})"


def _batched(spark, sf) -> DataFrame:
    """Batches of neighbouring ids."""
    return _encoded(spark, sf).withColumn("batch_id", F.floor(F.col("sample_id") / 16))


@query("k14_collated", f"""select sample_id, b::bigint as batch_id, w::bigint as width, md5(array_to_string(list_concat(ids, list_transform(range(w - len(ids)), lambda x: 0)), ',')) as input_ids,
 md5(array_to_string(list_concat(labels, list_transform(range(w - len(ids)), lambda x: -100)), ',')) as labels, len(ids)::bigint as n_real from {_BATCHED}""")
def k14(spark, sf):
    c = layout.collate(_batched(spark, sf), "batch_id", PAD)
    real = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("sample_id", "batch_id", F.size("input_ids").cast("long").alias("width"), digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"), real.alias("n_real"))


@query("k12_padding_mask", f"""select sample_id, (len(ids)::bigint * (len(ids) + 1) // 2 + (w - len(ids)) * len(ids))::bigint as n_visible from {_BATCHED}""")
def k12(spark, sf):
    c = layout.collate(_batched(spark, sf), "batch_id", PAD)
    return c.select("sample_id", layout.padding_visible(F.col("attention_mask")).alias("n_visible"))


_ACTIVE = "len(list_filter(labels, lambda x: x <> -100))"


@query("k17_accumulation", f"select (b // 4)::bigint as group_id, count(distinct b) as n_batches, sum({_ACTIVE})::bigint as n_targets from {_BATCHED} group by 1 having sum({_ACTIVE}) > 0")
def k17(spark, sf):
    rows = _batched(spark, sf).withColumn("n", F.size(F.filter("labels", lambda x: x != -100)).cast("long"))
    return layout.accumulation_groups(rows, "batch_id", 4, "n")


Q["w12_accumulation_numbers"], SQL["w12_accumulation_numbers"] = Q["k17_accumulation"], SQL["k17_accumulation"]


@query("a06_response_density", f"""select count(*) as samples, sum(len(labels))::bigint as total, sum({_ACTIVE})::bigint as active, round(sum({_ACTIVE})::double / sum(len(labels)), 9) as ratio, min({_ACTIVE}) as least, max({_ACTIVE}) as most, round(avg({_ACTIVE}), 6) as mean from {_ENCODED}""")
def a06(spark, sf):
    rows = _encoded(spark, sf).select(F.size("labels").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("a"))
    return rows.agg(F.count("*").alias("samples"), F.sum("n").cast("long").alias("total"), F.sum("a").cast("long").alias("active"), F.round(F.sum("a") / F.sum("n"), 9).alias("ratio"), F.min("a").alias("least"), F.max("a").alias("most"), F.round(F.avg("a"), 6).alias("mean"))


@query("a07_label_counts", f"select sum(len(labels))::bigint as total, sum({_ACTIVE})::bigint as active, (sum(len(labels)) - sum({_ACTIVE}))::bigint as masked, round(sum({_ACTIVE})::double / sum(len(labels)), 9) as ratio from {_ENCODED}")
def a07(spark, sf):
    return stats.label_counts(_encoded(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@query("a08_audit", f"""with b as (select b, sum(len(labels)) as t, sum({_ACTIVE}) as a from {_BATCHED} group by 1) select count(*) as n_batches, sum(t)::bigint as n_tokens, sum(a)::bigint as n_active, count(*) filter (a = 0) as n_fully_masked,
 round(sum(a)::double / sum(t), 9) as ratio, count(*) filter (a = 0) > 0 as warn_masked, sum(a)::double / sum(t) < 0.05 as warn_ratio from b""")
def a08(spark, sf):
    rows = _batched(spark, sf).select("batch_id", F.size("labels").cast("long").alias("t"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("a"))
    return stats.audit(rows, "batch_id", "t", "a").withColumn("ratio", F.round("ratio", 9))


@query("a09_mask_report", f"""select sample_id, len(labels)::bigint as n_tokens, {_ACTIVE}::bigint as n_active, (len(labels) - {_ACTIVE})::bigint as n_masked, round({_ACTIVE}::double / len(labels), 9) as active_ratio,
 coalesce(nullif(list_position(list_transform(labels, lambda x: x <> -100), true), 0) - 1, len(labels))::bigint as prompt_end from {_ENCODED}""")
def a09(spark, sf):
    r = _encoded(spark, sf).select("sample_id", stats.mask_report(F.col("labels")).alias("r"))
    return r.select("sample_id", F.col("r.n_tokens").cast("long").alias("n_tokens"), F.col("r.n_active").cast("long").alias("n_active"), F.col("r.n_masked").cast("long").alias("n_masked"), F.round("r.active_ratio", 9).alias("active_ratio"), F.col("r.prompt_end").cast("long").alias("prompt_end"))


_REPORTS = "(select distinct on (report_id) * from mask_reports order by report_id, received_at)"


@query("a08_run_audit", """with r as (select report_id, min(run_id) as run_id, min(n_tokens) as t, min(n_active) as a, min(n_masked) as m from mask_reports group by 1)
 select run_id, count(*) as n_reports, sum(case when t > 0 then t else 0 end)::bigint as n_tokens, sum(a)::bigint as n_active, count(*) filter (a = 0) as n_fully_masked from r group by 1""")
def a08_runs(spark, sf):
    """Audit of the delivered reports by run; a report counts once. Reports are collapsed before runs are added up, so no run is one task's."""
    r = table(spark, sf, "mask_reports").groupBy("report_id").agg(F.min("run_id").alias("run_id"), F.min("n_tokens").alias("t"), F.min("n_active").alias("a"))
    return r.groupBy("run_id").agg(F.count("*").alias("n_reports"), F.sum(F.when(F.col("t") > 0, F.col("t")).otherwise(0)).cast("long").alias("n_tokens"), F.sum("a").cast("long").alias("n_active"), F.count_if(F.col("a") == 0).alias("n_fully_masked"))


@query("k02_sample_split", f"""select sample_id, row_number() over (order by md5('13|' || sample_id), sample_id) <= greatest(1, floor(count(*) over () * 0.1)) as is_val from {ALPACA}""")
def k02(spark, sf):
    return layout.split_documents(alpaca(spark, sf), 13, 0.1, "sample_id").select("sample_id", "is_val")


@query("k03_capped_split", f"""with s as (select sample_id from {_SCANNED} order by sample_id limit 400), r as (select sample_id, row_number() over (order by md5('13|' || sample_id), sample_id) as rn, count(*) over () as n from s) select sample_id, rn <= greatest(1, floor(n * 0.1)) as is_val from r""")
def k03(spark, sf):
    """The first samples up to the cap, split by the ratio."""
    first = line_sources.samples(_sample_lines(spark, sf), "sample_id").select("sample_id")
    return layout.load_split(first, None, 0.1, 13, "sample_id", 400)


@query("k03_validation_file", f"""with s as (select sample_id, sample_id % 7 = 0 as v from {_SCANNED}), r as (select *, row_number() over (partition by v order by sample_id) as rn from s) select sample_id, v as is_val from r where rn <= case when v then 40 else 400 end""")
def k03_file(spark, sf):
    """Validation samples from a table of their own, both sides capped."""
    all_samples = line_sources.samples(_sample_lines(spark, sf), "sample_id").select("sample_id")
    return layout.load_split(all_samples.where("sample_id % 7 <> 0"), all_samples.where("sample_id % 7 = 0"), 0.1, 13, "sample_id", 400)


@query("k03_uncapped", f"select sample_id, row_number() over (order by md5('13|' || sample_id), sample_id) <= greatest(1, floor(count(*) over () * 0.1)) as is_val from {_SCANNED}")
def k03_uncapped(spark, sf):
    return layout.load_split(line_sources.samples(_sample_lines(spark, sf), "sample_id").select("sample_id"), None, 0.1, 13, "sample_id")
