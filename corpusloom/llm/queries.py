"""Queries of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import containers, defects, encoding, groups, leakage, mixing, neardup, overlap, truncation


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def p1_windows(spark: SparkSession, sf: str) -> DataFrame:
    return containers.fill_windows(_read(spark, sf, "mask_reports"), _read(spark, sf, "audit_runs"))


def p1_filling(spark: SparkSession, sf: str) -> DataFrame:
    return containers.filling(p1_windows(spark, sf))


def p1_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """By run: reports, tokens, overfull windows, reports whose pieces aren't their tokens in a row, and reports divided though they fit."""
    windows = p1_windows(spark, sf)
    over = windows.groupBy("run_id", "window").agg((F.sum("n_tokens") > F.max("max_seq_len")).cast("long").alias("n_overfull")).groupBy("run_id").agg(F.sum("n_overfull").alias("n_overfull"))
    one = windows.groupBy("run_id", "report_id").agg(F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"), F.count_distinct("start").alias("starts"), F.max("max_seq_len").alias("cap"))
    sound = (F.col("t") == F.col("end")) & (F.col("pieces") == F.col("starts"))
    by_run = one.groupBy("run_id").agg(F.count("*").alias("n_reports"), F.sum("t").cast("long").alias("n_tokens"), F.count_if(~sound).alias("n_unsound"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("cap"))).alias("n_divided"))
    return by_run.join(over, "run_id")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.values(_read(spark, sf, "alpaca_samples"), _read(spark, sf, "chat_samples"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    values = _values(spark, sf)
    return truncation.score_values(values, truncation.fit_truncation(values))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("truncated").select("sample_id", "field", "turn").distinct()


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_scored(spark, sf))


def _conversations(spark: SparkSession, sf: str) -> neardup.NearDuplicates:
    chat = _read(spark, sf, "chat_samples")
    text = F.array_join(F.transform("messages", lambda m: m["content"]), " ")
    return neardup.near_duplicates(chat, "sample_id", text)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of every class and of every two linked classes.

    They are distinct as they are made, so they aren't shuffled once more for
    it, unless deliveries of one id differ in their words.
    """
    near = _conversations(spark, sf)
    members = near.members.select("id", "bag")
    a, b = members.select(F.col("id").alias("x"), F.col("bag").alias("bag_a")), members.select(F.col("id").alias("y"), F.col("bag").alias("bag_b"))
    equal = a.join(b, (F.col("bag_a") == F.col("bag_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    linked = near.links.join(a, "bag_a").join(b, "bag_b").select("x", "y").where("x <> y")
    pairs = equal.unionByName(linked).select(F.least("x", "y").alias("sample_id_a"), F.greatest("x", "y").alias("sample_id_b"))
    return pairs.distinct() if members.groupBy("id").count().where("count > 1").head(1) else pairs


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation with text: its class of equal texts, its group of nearly same ones, and its links."""
    near = _conversations(spark, sf)
    links = near.links.select(F.col("bag_a").alias("a"), F.col("bag_b").alias("b"))
    root = groups.connected(links)
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("links"))
    members = near.members.select(F.col("id").alias("sample_id"), F.col("bag").alias("class_id")).distinct()
    out = members.join(root.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree.withColumnRenamed("a", "class_id"), "class_id", "left")
    return out.select("sample_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("n_linked_classes"))


def _overlaps(spark: SparkSession, sf: str) -> overlap.SplitOverlaps:
    return overlap.split_overlaps(_read(spark, sf, "documents"), _read(spark, sf, "split_meta"))


def p4_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One row per build and listed document: its class and the numbers of its counterparts on the other side."""
    return _overlaps(spark, sf).documents()


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).pairs()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pairs(spark, sf).select("build_id", F.least("train_doc", "val_doc").alias("doc_id_a"), F.greatest("train_doc", "val_doc").alias("doc_id_b")).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).report()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    alpaca, chat = _read(spark, sf, "alpaca_samples"), _read(spark, sf, "chat_samples")
    labelled = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    voters = defects.fit_voters(alpaca, chat, truncation.fit_truncation(truncation.values(alpaca, chat)), labelled)
    found, _ = defects.find_defects(alpaca, chat, voters)
    return found.select("sample_id", "turn", "defect").distinct()


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1]


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """By source of the targets: rows beyond the allowed repeats, and rows that come twice."""
    documents, targets = _read(spark, sf, "documents"), _read(spark, sf, "mix_targets")
    rows = mixing.mix(documents, targets)[0].join(targets.select("source", "max_repeats"), "source")
    by = rows.groupBy("source", "doc_id").agg(F.count_if(F.col("copy") >= F.col("max_repeats")).alias("over"), (F.count("*") - F.count_distinct("copy")).alias("twice")).groupBy("source").agg(F.sum("over").alias("n_over"), F.sum("twice").alias("n_twice"))
    return targets.select("source").distinct().join(by, "source", "left").select("source", F.coalesce("n_over", F.lit(0)).cast("long").alias("n_over"), F.coalesce("n_twice", F.lit(0)).cast("long").alias("n_twice"))


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    return encoding.garbled(documents, encoding.fit_encoding(documents))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_restored(spark, sf).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_windows, p1_filling, p1_invariants, p2_found, p2_rates, p3_found, p3_groups, p4_found, p4_report, p4_documents, p4_pairs, p5_found, p6_found, p6_leaks, p7_mixture, p7_shares, p7_invariants, p8_found, p8_restored)
    return {f.__name__: f for f in named}


def _near_sql(texts: str, key: str, group: str) -> str:
    """Common tables of texts (key, grp, text): size (key, n) and shared (x < y, s): words shared by two texts of a group, counted with multiplicity."""
    words = "list_filter(list_transform(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\v\\f]+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> '')"
    return f"""with texts as ({texts}), counts as (select {key}, {group} as grp, w, count(*) as n from (select {key}, {group}, unnest({words}) as w from texts) group by all),
 size as (select {key}, sum(n) as n from counts group by 1),
 shared as (select a.{key} as x, b.{key} as y, sum(least(a.n, b.n)) as s from counts a join counts b on a.grp = b.grp and a.w = b.w and a.{key} < b.{key} group by 1, 2),
 near as (select x, y, s = a.n and s = b.n as equal from shared join size a on a.{key} = x join size b on b.{key} = y where s >= 0.85 * greatest(a.n, b.n) - 1e-9)"""


_CHATS = "select sample_id, 0 as grp, array_to_string(list_transform(any_value(messages), lambda m: m.content), ' ') as text from chat_samples where sample_id is not null and messages is not null group by 1"
_SIDES = "(select distinct build_id, shard_no, 'train' as side, unnest(train_doc_indices) as doc_index from split_meta union select distinct build_id, shard_no, 'val', unnest(val_doc_indices) from split_meta)"
_PAIRS = (
    _near_sql("select doc_id, shard_no, text from documents", "doc_id", "shard_no")
    + f""", placed as (select distinct build_id, side, d.doc_id, d.source from {_SIDES} l join documents d on d.shard_no = l.shard_no and d.doc_index = l.doc_index),
 both_ways as (select x, y, equal from near union all select y, x, equal from near),
 pairs as (select t.build_id, t.doc_id as train_doc, v.doc_id as val_doc, case when t.doc_id = v.doc_id then 'same' when b.equal then 'equal' else 'near' end as kind, t.source as train_source, v.source as val_source
 from placed t join placed v on t.build_id = v.build_id and t.side = 'train' and v.side = 'val' left join both_ways b on b.x = t.doc_id and b.y = v.doc_id where t.doc_id = v.doc_id or b.x is not null)"""
)
_SQL = {
    "p1_invariants": """select r.run_id, count(*) as n_reports, sum(t)::bigint as n_tokens, 0::bigint as n_unsound, 0::bigint as n_divided, 0::bigint as n_overfull
 from (select report_id, arg_min(run_id, (received_at, run_id, n_tokens)) as run_id, arg_min(n_tokens, (received_at, run_id, n_tokens)) as t from mask_reports where report_id is not null and run_id is not null and n_tokens > 0 group by 1) r
 join (select distinct run_id from audit_runs where max_seq_len > 0) a on a.run_id = r.run_id group by 1""",
    "p3_found": _near_sql(_CHATS, "sample_id", "grp") + " select x as sample_id_a, y as sample_id_b from near",
    "p4_found": _PAIRS + " select distinct build_id, least(train_doc, val_doc) as doc_id_a, greatest(train_doc, val_doc) as doc_id_b from pairs",
    "p4_pairs": _PAIRS + " select * from pairs",
    "p4_report": _PAIRS
    + """, sides as (select build_id, 'train' as side, train_source as source, kind, train_doc as doc from pairs union all select build_id, 'val', val_source, kind, val_doc from pairs)
 select build_id, side, source, kind, count(distinct doc) as n_documents, count(*) as n_pairs from sides group by all""",
    "p7_invariants": "select distinct source, 0::bigint as n_over, 0::bigint as n_twice from mix_targets",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the definitions of problems 3 and 4, and of what holds for any arrangement of problems 1 and 7.

    The others are compared with brute force, round trips and held-out cases in
    the tests.
    """
    return dict(_SQL)
