"""Queries over documents: scans, token streams, splits, windows and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EOS, LENGTH_RANGES
from ..functions.text import repetition_rate, strip, words
from ..functions.tokens import byte_decoder, byte_encoder, in_range, json_encoder, marked, piece_decoder, piece_encoder, stub_ids, stub_tokenizer, training_lines
from ..operators import compare, layout, quality, stats, vocabulary
from ..operators.prefix import ranked
from ..session import new_path
from ..sources import items as item_sources
from ..sources import lines as line_sources
from ..sources import sinks
from .common import TOKENIZED, WS, digest, sql_digest, table, tokenized

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Malformed lines, one more for every document whose id leaves this rest of 23.
_BAD = {0: "", 1: "   ", 2: "{bad", 3: "[1]", 4: '{"x":1}', 5: '{"text":null}', 6: '{"text":5}', 7: '{"text":"  "}'}


def _lines(spark, sf) -> DataFrame:
    """All documents as JSON lines, and malformed lines beside them."""
    docs = table(spark, sf, "documents")
    good = docs.select("doc_id", F.to_json(F.struct("text")).alias("line"))
    bad = F.lit(None).cast("string")
    for rest, line in _BAD.items():
        bad = F.when(F.col("doc_id") % 23 == rest, F.lit(line)).otherwise(bad)
    return good.unionByName(docs.select("doc_id", bad.alias("line")).where("line is not null"))


_CORPUS_REASON = """case doc_id % 23 when 1 then 'json_error' when 2 then 'json_error' when 3 then 'not_a_dict' when 4 then 'missing_text_field'
 when 5 then 'missing_text_field' when 6 then 'text_not_string' when 7 then 'empty_text' end"""
_CORPUS = f"""(select case when trim(text, {WS}) = '' then 'empty_text' end as reason, length(trim(text, {WS})) as n from documents union all select {_CORPUS_REASON}, 0 from documents where doc_id % 23 between 1 and 7)"""


@query("s01_corpus_scan", f"select coalesce(reason, 'valid') as reason, count(*) as n, sum(case when reason is null then n else 0 end)::bigint as n_chars from {_CORPUS} group by 1")
def s01(spark, sf):
    records = line_sources.corpus_records(_lines(spark, sf))
    return records.groupBy(F.coalesce(F.split("reason", ":")[0], F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))


_EXTRACT_REASON = """case doc_id % 23 when 0 then 'blank' when 1 then 'blank' when 2 then 'invalid_json' when 3 then 'missing_text_field' when 4 then 'missing_text_field'
 when 5 then 'invalid_text_type' when 6 then 'invalid_text_type' end"""
_EXTRACTED = f"(select null as reason, length(text) as n from documents union all select {_EXTRACT_REASON}, case when doc_id % 23 = 7 then 2 else 0 end from documents where doc_id % 23 <= 7)"


@query("s02_extraction", f"select coalesce(reason, 'valid') as reason, count(*) as n, sum(n)::bigint as n_chars from {_EXTRACTED} group by 1")
def s02(spark, sf):
    return line_sources.extracted(_lines(spark, sf)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))


@query("s03_loose_texts", f"""select count(*) as n, sum(length(trim(replace(text, chr(10), ' '), {WS})))::bigint as n_chars from documents where trim(replace(text, chr(10), ' '), {WS}) <> ''""")
def s03(spark, sf):
    return line_sources.loose_texts(_lines(spark, sf)).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("s04_token_scan", f"select count(*) as n_docs, sum(length(text) + 1)::bigint as n_tokens from documents where text <> ''")
def s04(spark, sf):
    return table(spark, sf, "documents").where("text <> ''").agg(F.count("*").alias("n_docs"), F.sum(F.size(marked(stub_ids("text")))).cast("long").alias("n_tokens"))


@query("s14_lengths_from_offsets", f"select doc_id, len(tokens)::bigint as n_tokens from {TOKENIZED}")
def s14(spark, sf):
    return layout.lengths(layout.offsets(tokenized(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"))))


Q["w03_offset_differences"], SQL["w03_offset_differences"] = Q["s14_lengths_from_offsets"], SQL["s14_lengths_from_offsets"]


@query("s13_token_bytes", f"""select doc_id, (len(tokens) * 2)::bigint as n_bytes, md5(unhex(array_to_string(list_transform(tokens, lambda t: printf('%02x%02x', t % 256, t // 256)), ''))) as digest from {TOKENIZED}""")
def s13(spark, sf):
    return sinks.token_bytes(tokenized(spark, sf)).select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


_INDEX = f"""(with t as (select doc_id, len(tokens)::bigint as n from {TOKENIZED}), s as (select doc_id, n, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as b from t)
 select doc_id, n as n_tokens, b * 2 as start_byte, (b + n) * 2 as end_byte from s)"""


@query("s13_token_cache", f"select i.*, t.total as total_tokens from {_INDEX} i join (select doc_id, list_sum(tokens)::bigint as total from {TOKENIZED}) t on t.doc_id = i.doc_id")
def s13_cache(spark, sf):
    """Tokens and index as written by the sink and read back."""
    path = new_path(spark)
    sinks.write_tokens(tokenized(spark, sf), path)
    tokens = spark.read.parquet(f"{path}/tokens").select("doc_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_tokens"))
    return spark.read.parquet(f"{path}/index").join(tokens, "doc_id")


@query("s15_written_split", f"""with s as (select doc_id, tokens, (row_number() over (order by md5('42|' || doc_id), doc_id) <= greatest(1, floor(count(*) over () * 0.05))) as v from {TOKENIZED})
 select case when v then 'val' else 'train' end as split, count(*) as n_docs, sum(len(tokens))::bigint as n_tokens from s group by 1""")
def s15_written(spark, sf):
    """A split as written by the sink and read back."""
    path = new_path(spark)
    sinks.write_split(layout.split_documents(tokenized(spark, sf), 42, 0.05), path, 42, 0.05)
    return spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


_VAL = "(row_number() over (order by md5('42|' || doc_id), doc_id) <= greatest(1, floor(count(*) over () * 0.05)))"


@query("s15_split_summary", f"""with s as (select tokens, {_VAL} as v from {TOKENIZED}) select 42::bigint as seed, 0.05::double as val_ratio, count(*) as n_docs_total,
 count(*) filter (not v) as n_docs_train, count(*) filter (v) as n_docs_val, sum(case when v then 0 else len(tokens) end)::bigint as n_tokens_train, sum(case when v then len(tokens) else 0 end)::bigint as n_tokens_val from s""")
def s15(spark, sf):
    return sinks.split_summary(layout.split_documents(tokenized(spark, sf), 42, 0.05), 42, 0.05)


@query("s18_merge", """select domain_name as domain, count(*) as n, sum(length(text))::bigint as n_chars from (select 'documents' as domain_name, text from documents union all select 'items', ctx from eval_items) group by 1""")
def s18(spark, sf):
    parts = {"documents": table(spark, sf, "documents").select("text"), "items": table(spark, sf, "eval_items").select(F.col("ctx").alias("text"), "benchmark")}
    return line_sources.merge_domains(parts).groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("pf01_strip", f"select doc_id, length(trim(' ' || chr(160) || text || chr(8195) || chr(28), {WS})) as n_chars, md5(trim(text, {WS})) as digest from documents")
def p01(spark, sf):
    padded = F.concat(F.lit("  "), "text", F.lit(" \x1c"))
    return table(spark, sf, "documents").select("doc_id", F.length(strip(padded)).cast("long").alias("n_chars"), F.md5(strip("text")).alias("digest"))


@query("pf02_valid_utf8", "select doc_id, true as valid, (length(text) + 1)::bigint as n_chars from documents")
def p02(spark, sf):
    """Nearest thing to repairing lone surrogates: bytes that are no UTF-8 are replaced."""
    return table(spark, sf, "documents").select("doc_id", F.make_valid_utf8(F.concat(F.col("text"), F.lit(b"\xff").cast("string"))).alias("text")).select("doc_id", F.is_valid_utf8("text").alias("valid"), F.length("text").cast("long").alias("n_chars"))


@query("pf10_over_length", f"select count(*) filter (len(tokens) > 4096) as n_over, count(*) as n from {TOKENIZED}")
def p10(spark, sf):
    return tokenized(spark, sf).agg(F.count_if(F.size("tokens") > 4096).alias("n_over"), F.count("*").alias("n"))


@query("pf11_rejects", f"select reason, count(*) as n from {_CORPUS} where reason is not null group by 1")
def p11(spark, sf):
    return quality.rejects_by_reason(line_sources.corpus_records(_lines(spark, sf)))


@query("l01_rejects_sorted", f"select reason, count(*) as n from {_CORPUS} where reason is not null group by 1 order by n desc, reason")
def l01(spark, sf):
    return quality.rejects_by_reason(line_sources.corpus_records(_lines(spark, sf)))


@query("t01_stub_tokens", f"select doc_id, len(tokens) as n_tokens, {sql_digest('tokens')} as digest from {TOKENIZED}")
def t01(spark, sf):
    return tokenized(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


def _model() -> str:
    return "/opt/tokenizers/piece_bpe_32k.model"


# one vocabulary, in the files of two libraries
_BYTE_MODEL, _JSON_MODEL = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json"


@query("t01_subword_tokens")
def t01_subword(spark, sf):
    ids = marked(piece_encoder(_model())("text"), bos=True)
    return table(spark, sf, "documents").select("doc_id", ids.alias("tokens")).select("doc_id", F.size("tokens").alias("n_tokens"), in_range(F.col("tokens")).alias("in_range"))


@query("t02_tokenizer", f"select doc_id, len(tokens)::bigint + 1 as n_tokens from {TOKENIZED}")
def t02(spark, sf):
    tokenizer = stub_tokenizer()
    return table(spark, sf, "documents").select("doc_id", F.size(tokenizer.ids(F.col("text"), bos=2, eos=True)).cast("long").alias("n_tokens"))


_LINE = "trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), " + WS + ")"


@query("t03_training_lines", f"select doc_id, md5({_LINE}) as line from documents where {_LINE} <> '' and octet_length(encode({_LINE})) <= 16384")
def t03(spark, sf):
    """The corpus of a tokenizer, prepared; tokenizers aren't trained here."""
    return training_lines(table(spark, sf, "documents")).select("doc_id", F.md5("line").alias("line"))


@query("t04_training_lines_capped", f"select count(*) as n, max(octet_length(encode({_LINE}))) as longest from documents where {_LINE} <> '' and octet_length(encode({_LINE})) <= 2048")
def t04(spark, sf):
    return training_lines(table(spark, sf, "documents"), most_bytes=2048).agg(F.count("*").alias("n"), F.max(F.octet_length("line")).cast("long").alias("longest"))


@query("t06_round_trip", "select doc_id, true as same, length(text)::bigint as n_chars from documents")
def t06(spark, sf):
    """Encoding and decoding by the byte-level vocabulary gives the text back, character by character."""
    encode, decode = byte_encoder(_BYTE_MODEL), byte_decoder(_BYTE_MODEL)
    back = table(spark, sf, "documents").select("doc_id", "text", decode(encode("text")).alias("back"))
    return back.select("doc_id", (F.col("text") == F.col("back")).alias("same"), F.length("back").cast("long").alias("n_chars"))


_SQUEEZED = "trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g'))"


@query("t06_piece_round_trip")
def t06_piece(spark, sf):
    """By the piece vocabulary, which normalises: whether the text comes back as it is, and but for white space."""
    encode, decode = piece_encoder(_model()), piece_decoder(_model())
    back = table(spark, sf, "documents").select("doc_id", "text", decode(encode("text")).alias("back"))
    squeezed = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return back.select("doc_id", (F.col("text") == F.col("back")).alias("exact"), (squeezed(F.col("text")) == squeezed(F.col("back"))).alias("squeezed"))


@query("t09_parity", "select doc_id, true as same, null::int as first_difference from documents")
def t09(spark, sf):
    """The same texts under two implementations of one byte-level vocabulary, joined by probe: all ids agree, or the first place where they don't is told."""
    docs = table(spark, sf, "documents")
    a, b = docs.select("doc_id", byte_encoder(_BYTE_MODEL)("text").alias("a")), docs.select("doc_id", json_encoder(_JSON_MODEL)("text").alias("b"))
    return compare.array_parity(a.join(b, "doc_id"), "doc_id", "a", "b")


@query("t09_parity_failures", "select doc_id, false as same, (length(text) - length(regexp_extract(text, '[A-Z].*$', 0, 's')))::int as first_difference from documents where regexp_matches(text, '[A-Z]')")
def t09_failures(spark, sf):
    """Two encoders that do differ, the second one by lower case: the probes that fail, with the first place.

    Both encode the text where it is read: a join by probe would shuffle or broadcast the ids of all texts.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    both = table(spark, sf, "documents").select("doc_id", stub_ids("text").alias("a"), stub_ids(lower).alias("b"))
    return compare.array_parity(both, "doc_id", "a", "b").where("not same")


@query("k01_split", f"select doc_id, {_VAL} as is_val from documents")
def k01(spark, sf):
    return layout.split_documents(table(spark, sf, "documents").select("doc_id"), 42, 0.05).select("doc_id", "is_val")


@query("k04_offsets", f"""with t as (select doc_id, len(tokens)::bigint as n from {TOKENIZED}), s as (select doc_id, n, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as b from t)
 select doc_id, n as n_tokens, b * 2 as start_byte, (b + n) * 2 as end_byte from s""")
def k04(spark, sf):
    return layout.offsets(tokenized(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens")))


Q["w02_running_offsets"], SQL["w02_running_offsets"] = Q["k04_offsets"], SQL["k04_offsets"]

_STREAM = f"(select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from {TOKENIZED})"
_POSITIONS = f"(select row_number() over (order by doc_id, i) - 1 as pos, token from {_STREAM})"


def _shifted_sql(size: int) -> str:
    return f"""with s as (select pos // {size} as w, pos, token from {_POSITIONS}), e as (select w, pos, token from s union all select w - 1, pos, token from s where pos % {size} = 0 and pos > 0),
 l as (select w as window_id, list(token order by pos) as t from e group by w having count(*) = {size + 1})"""


@query("k05_windows", _shifted_sql(1024) + f" select window_id::bigint as window_id, {sql_digest('t[1:1024]')} as x, {sql_digest('t[2:1025]')} as y from l")
def k05(spark, sf):
    return layout.shifted_windows(tokenized(spark, sf), 1024).select("window_id", digest(F.col("x")).alias("x"), digest(F.col("y")).alias("y"))


@query("k06_window_count", f"select greatest(0, (sum(len(tokens))::bigint - 1) // 1024) as n_windows from {TOKENIZED}")
def k06(spark, sf):
    return layout.shifted_windows(tokenized(spark, sf), 1024).agg(F.count("*").alias("n_windows"))


@query("w07_next_token", _shifted_sql(256) + " select window_id::bigint as window_id, len(list_filter(range(1, 257), lambda i: t[i] = t[i + 1])) as n_repeats from l")
def w07(spark, sf):
    w = layout.shifted_windows(tokenized(spark, sf), 256)
    return w.select("window_id", F.size(F.filter(F.zip_with("x", "y", lambda a, b: a == b), lambda same: same)).cast("long").alias("n_repeats"))


@query("k07_epoch_order", _shifted_sql(1024) + " select window_id::bigint as window_id, md5('7|2|' || window_id) as shuffle_key from l")
def k07(spark, sf):
    return layout.shuffled(layout.shifted_windows(tokenized(spark, sf), 1024).select("window_id"), 7, 2)


@query("k08_batches", _shifted_sql(1024) + """, r as (select window_id, (window_id // 2) // 8 as batch_id from l where window_id % 2 = 1), f as (select batch_id from r group by 1 having count(*) = 8)
 select window_id::bigint as window_id, batch_id::bigint as batch_id from r where batch_id in (select batch_id from f)""")
def k08(spark, sf):
    return layout.batches(layout.shifted_windows(tokenized(spark, sf), 1024).select("window_id"), "window_id", 8, True, 2, 1)


_PACKED = f"(select pos // 2048 as window_id, list(token order by pos) as t from {_POSITIONS} group by 1 having count(*) = 2048)"


@query("k09_packed", f"select window_id::bigint as window_id, {sql_digest('t')} as digest from {_PACKED}")
def k09(spark, sf):
    return layout.packed_windows(tokenized(spark, sf), 2048).select("window_id", digest(F.col("tokens")).alias("digest"))


@query("k09_packed_padded", f"select (pos // 2048)::bigint as window_id, count(*) as n_tokens, sum(token)::bigint as total from {_POSITIONS} group by 1")
def k09_padded(spark, sf):
    w = layout.packed_windows(tokenized(spark, sf), 2048, pad=True)
    filled = F.size("tokens").cast("long")
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    # padding is taken off again, as SQL counts the stream
    last = layout.packed_windows(tokenized(spark, sf), 2048).select("window_id", F.lit(True).alias("whole"))
    sized = w.join(last, "window_id", "left")
    stream = tokenized(spark, sf).agg(F.sum(F.size("tokens")).cast("long").alias("all"))
    rest = sized.crossJoin(F.broadcast(stream)).select("window_id", F.when(F.col("whole"), filled).otherwise(F.col("all") % 2048).alias("n_tokens"), total.alias("total"))
    return rest.select("window_id", "n_tokens", (F.col("total") - (2048 - F.col("n_tokens")) * EOS).alias("total"))


@query("k10_document_ids", f"""with e as (select window_id, unnest(t) as token, generate_subscripts(t, 1) as i from {_PACKED}),
 d as (select window_id, i, coalesce(sum(case when token = 3 then 1 else 0 end) over (partition by window_id order by i rows between unbounded preceding and 1 preceding), 0) as doc from e)
 select window_id::bigint as window_id, md5(string_agg(doc::bigint::varchar, ',' order by i)) as digest, (max(doc) + 1)::bigint as n_docs from d group by 1""")
def k10(spark, sf):
    ids = layout.packed_windows(tokenized(spark, sf), 2048).select("window_id", layout.document_ids(F.col("tokens")).alias("d"))
    return ids.select("window_id", digest(F.col("d")).alias("digest"), (F.array_max("d") + 1).cast("long").alias("n_docs"))


_VISIBLE = f"""with e as (select window_id, unnest(t) as token, generate_subscripts(t, 1) as i from {_PACKED}),
 d as (select window_id, i, coalesce(sum(case when token = 3 then 1 else 0 end) over (partition by window_id order by i rows between unbounded preceding and 1 preceding), 0) as doc from e),
 v as (select window_id, doc, row_number() over (partition by window_id, doc order by i) as visible from d)"""


@query("k11_document_mask", _VISIBLE + " select window_id::bigint as window_id, doc::bigint as doc, count(*) as n, sum(visible)::bigint as n_visible from v group by 1, 2")
def k11(spark, sf):
    return layout.visible_totals(layout.packed_windows(tokenized(spark, sf), 2048))


for _alias in ("w01_running_document", "j10_mask_join"):
    Q[_alias], SQL[_alias] = Q["k11_document_mask"], SQL["k11_document_mask"]


@query("k13_shift", f"select doc_id, {sql_digest('tokens[1:len(tokens) - 1]')} as inputs, {sql_digest('tokens[2:]')} as targets from {TOKENIZED}")
def k13(spark, sf):
    x, y = layout.shift(F.col("tokens"))
    return tokenized(spark, sf).select("doc_id", digest(x).alias("inputs"), digest(y).alias("targets"))


@query("k15_spread", f"""with n as (select greatest(0, (sum(len(tokens))::bigint - 1) // 1024) as n from {TOKENIZED}) select distinct (i * n // 50)::bigint as window_id from n, range(50) t(i)""")
def k15(spark, sf):
    """Windows spread evenly over the stream; the positions are those of at most 50 windows."""
    windows = layout.shifted_windows(tokenized(spark, sf), 1024)
    n = windows.agg(F.count("*").alias("n"))
    picks = spark.range(50).crossJoin(F.broadcast(n)).select(F.floor(F.col("id") * F.col("n") / 50).alias("window_id")).distinct()
    return windows.join(F.broadcast(picks), "window_id", "left_semi").select("window_id")


_LISTED = """(select distinct build_id, shard_no, 'train' as side, unnest(train_doc_indices) as doc_index from split_meta union select distinct build_id, shard_no, 'val', unnest(val_doc_indices) from split_meta)"""


def _listed(spark, sf) -> DataFrame:
    builds = table(spark, sf, "split_meta")
    sides = [builds.select("build_id", "shard_no", F.lit(s).alias("side"), F.explode(f"{s}_doc_indices").alias("doc_index")) for s in ("train", "val")]
    return sides[0].unionByName(sides[1]).distinct()


@query("j01_disjoint", f"select t.build_id, count(*) as n_both from {_LISTED} t join {_LISTED} v on t.build_id = v.build_id and t.doc_index = v.doc_index and t.side = 'train' and v.side = 'val' group by 1")
def j01(spark, sf):
    listed = _listed(spark, sf).select("build_id", "doc_index", "side")
    both = listed.where("side = 'train'").drop("side").intersect(listed.where("side = 'val'").drop("side"))
    return both.groupBy("build_id").agg(F.count("*").alias("n_both"))


Q["u01_intersection"], SQL["u01_intersection"] = Q["j01_disjoint"], SQL["j01_disjoint"]


@query("j02_unassigned", f"""select b.build_id, count(*) as n_missing from (select distinct build_id, shard_no from split_meta) b join documents d on d.shard_no = b.shard_no
 where not exists (select 1 from {_LISTED} l where l.build_id = b.build_id and l.doc_index = d.doc_index) group by 1""")
def j02(spark, sf):
    builds = table(spark, sf, "split_meta").select("build_id", "shard_no").distinct()
    docs = builds.join(table(spark, sf, "documents").select("shard_no", "doc_index"), "shard_no")
    return docs.join(_listed(spark, sf), ["build_id", "doc_index"], "left_anti").groupBy("build_id").agg(F.count("*").alias("n_missing"))


@query("u02_coverage", f"select build_id, count(distinct doc_index) as n from {_LISTED} group by 1")
def u02(spark, sf):
    listed = _listed(spark, sf)
    train, val = (listed.where(F.col("side") == s).select("build_id", "doc_index") for s in ("train", "val"))
    return train.union(val).distinct().groupBy("build_id").agg(F.count("*").alias("n"))


@query("j03_regenerated", f"""with a as (select doc_id, {_VAL} as v from documents), b as (select doc_id, row_number() over (order by md5('43|' || doc_id), doc_id) <= greatest(1, floor(count(*) over () * 0.05)) as v from documents)
 select side, count(*) as n from (select 'left' as side, * from (select * from a except all select * from b) union all select 'right', * from (select * from b except all select * from a)) group by 1""")
def j03(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    a, b = (layout.split_documents(ids, seed, 0.05).select("doc_id", "is_val") for seed in (42, 43))
    return compare.differences(a, b).groupBy("side").agg(F.count("*").alias("n"))


Q["u03_set_equality"], SQL["u03_set_equality"] = Q["j03_regenerated"], SQL["j03_regenerated"]


_CHECKED = "select count(*) filter (start_byte < p) as n_falling, count(*) filter (start_byte <> e) as n_gaps, max(end_byte)::bigint as last_end from (select *, lag(start_byte) over (order by doc_id) as p, coalesce(lag(end_byte) over (order by doc_id), 0) as e from i)"


@query("w04_monotone", f"with i as {_INDEX}, s as (select sum(len(tokens))::bigint * 2 as size from {TOKENIZED}) select c.*, s.size as n_bytes, c.last_end = s.size as complete from ({_CHECKED}) c, s")
def w04(spark, sf):
    """The written index read back: every start against the row before, and the last end against the size of the tokens."""
    path = new_path(spark)
    sinks.write_tokens(tokenized(spark, sf), path)
    size = spark.read.parquet(f"{path}/tokens").agg((F.sum(F.size("tokens")).cast("long") * 2).alias("n_bytes"))
    return compare.offset_check(spark.read.parquet(f"{path}/index"), "doc_id").crossJoin(F.broadcast(size)).select("*", (F.col("last_end") == F.col("n_bytes")).alias("complete"))


@query("w04_broken", f"with i as (select doc_id, case when doc_id % 97 = 1 then greatest(start_byte - 40000, 0) else start_byte end as start_byte, case when doc_id % 89 = 1 then end_byte + 2 else end_byte end as end_byte from {_INDEX}) {_CHECKED}")
def w04_broken(spark, sf):
    """An index with starts moved back and ends moved on."""
    index = layout.offsets(tokenized(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens")))
    start, end = F.col("start_byte"), F.col("end_byte")
    broken = index.select("doc_id", F.when(F.col("doc_id") % 97 == 1, F.greatest(start - 40000, F.lit(0))).otherwise(start).alias("start_byte"), F.when(F.col("doc_id") % 89 == 1, end + 2).otherwise(end).alias("end_byte"))
    return compare.offset_check(broken, "doc_id")


_N = f"(select doc_id, len(tokens)::bigint as n_tokens from {TOKENIZED})"


def _sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.size(marked(stub_ids("text"))).cast("long").alias("n_tokens"))


@query("a01_length_stats", f"""select count(*) as n_docs, count(*) filter (n_tokens > 0) as n_nonempty, sum(n_tokens)::bigint as n_tokens, avg(n_tokens) as mean, stddev_pop(n_tokens) as std, min(n_tokens) as min, max(n_tokens) as max,
 quantile_cont(n_tokens, 0.25) as p25, quantile_cont(n_tokens, 0.5) as p50, quantile_cont(n_tokens, 0.75) as p75, quantile_cont(n_tokens, 0.95) as p95, quantile_cont(n_tokens, 0.99) as p99,
 count(*) filter (n_tokens > 4096) as n_over, count(*) filter (n_tokens > 4096) * 100.0::double / count(*) as pct_over from {_N}""")
def a01(spark, sf):
    out = stats.length_stats(_sizes(spark, sf))
    return out.withColumn("pct_over", F.col("pct_over").cast("double"))


@query("a02_histogram", f"""with s as (select min(n_tokens) as lo, max(n_tokens) as hi, count(*) as a from {_N}), c as (select least((n_tokens - lo) * 20 // (hi - lo), 19) as bin, count(*) as n from {_N}, s group by 1)
 select i::int as bin, (lo + (hi - lo) * i // 20)::bigint as lo, (lo + (hi - lo) * (i + 1) // 20)::bigint as hi, coalesce(n, 0) as count, coalesce(n, 0) * 100.0::double / a as pct from range(20) t(i) cross join s left join c on bin = i""")
def a02(spark, sf):
    h = stats.histogram(_sizes(spark, sf))
    return h.withColumn("pct", F.col("pct").cast("double"))


@query("a03_ranges", f"""select lo::int as lo, (select count(*) from {_N} where n_tokens >= lo and n_tokens < hi) as count from (values {', '.join(f'({a}, {b})' for a, b in zip(LENGTH_RANGES, (*LENGTH_RANGES[1:], 1 << 60)))}) t(lo, hi)""")
def a03(spark, sf):
    return stats.range_buckets(_sizes(spark, sf))


@query("a04_token_counts", f"select count(*) as n_docs, sum(n_tokens)::bigint as n_tokens, avg(n_tokens) as mean, min(n_tokens) as min, max(n_tokens) as max from {_N}")
def a04(spark, sf):
    return stats.token_counts(_sizes(spark, sf))


@query("a11_extraction_counts", f"select coalesce(reason, 'valid') as category, count(*) as n from {_EXTRACTED} group by 1")
def a11(spark, sf):
    return line_sources.extracted(_lines(spark, sf)).groupBy(F.coalesce("reason", F.lit("valid")).alias("category")).agg(F.count("*").alias("n"))


_WORDS = "list_filter(regexp_split_to_array(text, '[' || " + WS + " || ']+'), lambda w: w <> '')"


@query("a23_repetition", f"""with w as (select doc_id, {_WORDS} as w from documents), g as (select doc_id, w, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')) as g from w)
 select doc_id, case when len(w) <= 8 then 0.0::double else 1 - len(list_distinct(g))::double / len(g) end as rate from g""")
def a23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", repetition_rate("text").alias("rate"))


@query("a24_repetition_by_source", f"""with w as (select source, {_WORDS} as w from documents), g as (select source, w, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')) as g from w),
 r as (select source, case when len(w) <= 8 then 0.0::double else 1 - len(list_distinct(g))::double / len(g) end as rate from g) select source, count(*) as n, round(avg(rate), 6) as mean_repetition from r group by rollup(source)""")
def a24(spark, sf):
    return stats.repetition(table(spark, sf, "documents").select("source", "text"), ["source"]).withColumn("mean_repetition", F.round("mean_repetition", 6))


@query("f01_words", f"select doc_id, len({_WORDS}) as n_words, starts_with(lower(text), 'the') as the, contains(text, 'flaw') as flaw from documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(words("text")).cast("long").alias("n_words"), F.startswith(F.lower("text"), F.lit("the")).alias("the"), F.contains("text", F.lit("flaw")).alias("flaw"))


@query("f02_regex", r"select doc_id, len(regexp_extract_all(text, '[A-Z]{3}-[0-9]{4}-[0-9]+')) as n_codes, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as digest from documents")
def f02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z]{3}-[0-9]{4}-[0-9]+"), F.lit(0))).cast("long").alias("n_codes"), F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("digest"))


@query("f05_json", "select doc_id, json_extract_string(json_object('text', text, 'lang', lang), '$.lang') as lang from documents")
def f05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(F.to_json(F.struct("text", "lang")), "$.lang").alias("lang"))


@query("f08_file_hash", "select sha256(string_agg(n_name || chr(10), '' order by n_nationkey)) as sha256 from nation")
def f08_file(spark, sf):
    """The hash of a file: names written as lines of one file."""
    path = new_path(spark)
    sinks.write_lines(table(spark, sf, "nation").select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("line")), path)
    return sinks.file_hash(spark, f"{path}/*.txt").select("sha256")


@query("f08_sha256", "select doc_id, sha256(text) as sha256 from documents")
def f08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# a vocabulary of the corpus' plain words and their letters, in lines "piece TAB score"
_VOCAB = """(select row_number() over (order by n desc, piece) - 1 as id, piece, -ln(row_number() over (order by n desc, piece))::double as score from
 (select piece, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as piece from documents union all select unnest(string_split(lower(text), '')) from documents) where regexp_matches(piece, '^[a-z]+$') group by 1))"""


def _vocabulary(spark, sf) -> DataFrame:
    """Pieces by falling count, ranked by range partitions."""
    docs = table(spark, sf, "documents").select("text")
    plain = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("piece"))
    letters = docs.select(F.explode(F.split(F.lower("text"), "")).alias("piece")).where(F.col("piece").rlike("^[a-z]+$"))
    counts = plain.unionAll(letters).groupBy("piece").agg(F.count("*").alias("n"))
    numbered = ranked(counts, F.desc("n"), "piece", out="id").withColumn("id", F.col("id") - 1)
    lines = numbered.select("id", F.concat_ws("\t", "piece", (-F.log(F.col("id") + 1)).cast("string")).alias("line"))
    return item_sources.vocabulary(lines, "id")


@query("s10_vocabulary", f"select id::int as id, piece, round(score, 6) as score from {_VOCAB}")
def s10(spark, sf):
    return _vocabulary(spark, sf).withColumn("score", F.round("score", 6) + 0.0)


# Pieces of every kind with their ids, some of them control tokens under right and wrong ids.
_SPECIAL = ((0, "<pad>"), (1, "<unk>"), (2, "<s>"), (3, "</s>"), (4, "<system>"), (6, "<user>"), (5, "<assistant>"), (7, "<end>"), (8, "<think>"), (9, "</think>"), (11, "<tool_call>"), (13, "</tool>"), (14, "<code>"), (99, "</code>"), (20, "<0x41>"), (21, "<0xFF>"), (22, "<0xfg>"), (23, "<own>"), (24, "\u2581the"), (25, "\u2581"), (26, "<"))
_SPECIAL_SQL = "(select * from (values " + ", ".join(f"({i}, '{p}')" for i, p in _SPECIAL) + ") t(id, piece))"
_PROTOCOL = "(values ('<system>',4),('<user>',5),('<assistant>',6),('<end>',7),('<think>',8),('</think>',9),('<tool_list>',10),('<tool_call>',11),('<tool_result>',12),('</tool>',13),('<code>',14),('</code>',15)) t(piece, expected)"


def _special(spark) -> DataFrame:
    return spark.createDataFrame([(i, p, 0.0) for i, p in _SPECIAL], "id int, piece string, score double")


@query("t05_protocol", f"select piece, expected::int as expected, null::int as actual from {_PROTOCOL}")
def t05(spark, sf):
    """The corpus vocabulary has no control tokens: every one is a problem."""
    return vocabulary.protocol_problems(_vocabulary(spark, sf))


@query("t05_protocol_mixed", f"select p.piece, expected::int as expected, v.id::int as actual from (select * from {_PROTOCOL}) p left join {_SPECIAL_SQL} v on v.piece = p.piece where v.id is null or v.id <> expected")
def t05_mixed(spark, sf):
    """Control tokens of which some are right, some have another id and some are missing."""
    return vocabulary.protocol_problems(_special(spark))


@query("t07_pieces", f"""with v as (select piece from {_VOCAB} union all select piece from {_SPECIAL_SQL}),
 k as (select piece, case when piece = '<unk>' then 'unknown' when piece in ('<s>', '</s>', '<pad>') then 'control' when regexp_full_match(piece, '<0x[0-9A-F]{{2}}>') then 'byte' when piece like '<%' and piece like '%>' then 'user-defined' else 'normal' end as kind from v)
 select kind, count(*) as n, round(avg(length(replace(piece, chr(9601), ''))), 6) as mean_length from k group by 1""")
def t07(spark, sf):
    """The corpus vocabulary with pieces of every kind."""
    pieces = _vocabulary(spark, sf).unionByName(_special(spark))
    return vocabulary.analysis(pieces).withColumn("mean_length", F.round("mean_length", 6))


@query("t07_characters", f"select count(distinct c) as n_characters from (select unnest(string_split(piece, '')) as c from {_VOCAB})")
def t07_characters(spark, sf):
    return vocabulary.characters(_vocabulary(spark, sf))


@query("l02_best_pieces", f"select id::int as id, piece, round(score, 6) as score from {_VOCAB} order by score desc, id limit 50")
def l02(spark, sf):
    return vocabulary.best(_vocabulary(spark, sf), 50).withColumn("score", F.round("score", 6) + 0.0)


@query("t08_merges", f"""with v as (select * from {_VOCAB}), c as (select id, piece, score, unnest(range(1, length(piece))) as k from v)
 select c.id::int as piece_id, l.id::int as left_id, r.id::int as right_id, row_number() over (order by c.score desc, c.id, l.id, r.id) as place from c join v l on l.piece = substr(c.piece, 1, k) join v r on r.piece = substr(c.piece, k + 1)""")
def t08(spark, sf):
    return vocabulary.merges(_vocabulary(spark, sf)).select("piece_id", "left_id", "right_id", "place")


Q["j05_merge_halves"], SQL["j05_merge_halves"] = Q["t08_merges"], SQL["t08_merges"]


@query("j04_piece_lookup", f"select w.piece, v.id::int as id from (values ('the'), ('flaw'), ('zzzz')) w(piece) left join {_VOCAB} v on v.piece = w.piece")
def j04(spark, sf):
    wanted = spark.createDataFrame([("the",), ("flaw",), ("zzzz",)], "piece string")
    return wanted.join(_vocabulary(spark, sf).select("piece", "id"), "piece", "left")


@query("u04_distinct", "select sum(len(list_distinct(string_split(text, ''))))::bigint as n_by_doc from documents")
def u04(spark, sf):
    return table(spark, sf, "documents").agg(F.sum(F.size(F.array_distinct(F.split("text", "")))).cast("long").alias("n_by_doc"))
