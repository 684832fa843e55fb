"""Queries on schedules, budgets and tables of names and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedules
from ..functions.text import bar, duration, thousands
from ..operators import compare
from ..sources import items as item_sources
from ..sources import sinks
from .common import table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("f03_formats", """select o_orderkey, format('{:,}', o_orderkey * 1000) as n, case when o_orderkey // 3600 > 0 then printf('%dh%02dm%02ds', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) when o_orderkey % 3600 // 60 > 0 then printf('%dm%02ds', o_orderkey % 3600 // 60, o_orderkey % 60) else printf('%ds', o_orderkey % 60) end as took,
 repeat('#', (o_orderkey % 41)::int) as bar from orders""")
def f03(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", thousands(k * 1000).alias("n"), duration(k).alias("took"), bar(k % 41, F.lit(40), 40).alias("bar"))


@query("f04_functions", "select o_orderkey, round(exp(-o_totalprice / 100000), 9) as e, round(sqrt(o_totalprice), 6) as s, round(cos(o_totalprice), 6) as c, least(greatest(o_totalprice, 1000), 100000) as clamped from orders")
def f04(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.exp(-p / 100000), 9).alias("e"), F.round(F.sqrt(p), 6).alias("s"), F.round(F.cos(p), 6).alias("c"), F.least(F.greatest(p, F.lit(1000.0)), F.lit(100000.0)).alias("clamped"))


@query("f06_arrays", "select l_orderkey, sum(l_linenumber)::bigint as total, list_contains(list(l_returnflag), 'R') as returned, count(*) as n from lineitem group by 1")
def f06(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list("l_linenumber").alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return g.select("l_orderkey", total.alias("total"), F.exists("f", lambda x: x == "R").alias("returned"), F.size("n").cast("long").alias("n"))


@query("f07_grouping", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def f07(spark, sf):
    """Counts by two keys, through a map by the first."""
    one = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    maps = one.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("m"))
    return maps.select("l_returnflag", F.explode("m").alias("l_linestatus", "n"))


_STEPS = "(select i as step from range(1200) t(i))"


def _steps(spark):
    return spark.range(1200).withColumnRenamed("id", "step")


@query("f09_warm_cosine", f"select step, round(case when step < 100 then 0.0006 * step / 100 when step >= 1000 then 0.00006 else 0.00006 + 0.5 * (1 + cos(pi() * (step - 100) / 900)) * (0.0006 - 0.00006) end, 12) as lr from {_STEPS}")
def f09(spark, sf):
    return _steps(spark).select("step", F.round(schedules.warm_cosine(F.col("step"), 6e-4, 6e-5, 100, 1000), 12).alias("lr"))


@query("f10_warm_stable_decay", f"select step, round(case when step < 50 then (step + 1) / 50 when step < 800 then 1 else 0.1 + 0.9 * (1 - sqrt(least(1, (step - 800) / 200))) end, 9) as m, round(case when step < 50 then (step + 1) / 50 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (step - 50) / 950))) end, 9) as c from {_STEPS}")
def f10(spark, sf):
    s = F.col("step")
    return _steps(spark).select("step", F.round(schedules.warm_stable_decay(s, 50, 1000, 200, 0.1), 9).alias("m"), F.round(schedules.cosine_multiplier(s, 50, 1000, 0.1), 9).alias("c"))


@query("f11_tuning", f"select step, round(case when step < 50 then greatest(1e-8, step / 50) else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (step - 50) / 950))) end, 9) as cosine, round(case when step < 50 then greatest(1e-8, step / 50) else greatest(0.1, 1 - (step - 50) / 950) end, 9) as linear, round(case when step < 50 then greatest(1e-8, step / 50) else 1 end, 9) as constant from {_STEPS}")
def f11(spark, sf):
    s = F.col("step")
    return _steps(spark).select("step", *(F.round(schedules.tuning_multiplier(s, k, 50, 1000, 0.1), 9).alias(k) for k in ("cosine", "linear", "constant")))


# Name, vocabulary, width, layers, heads, key-value heads, head size and context of three model sizes.
PRESETS = [("wide", 32768, 768, 12, 12, 2, 64, 2048), ("middle", 32768, 512, 12, 8, 2, 64, 2048), ("narrow", 32768, 128, 4, 4, 1, 32, 256)]
CORPUS_TOKENS = 204_501_030


def _presets(spark):
    return spark.createDataFrame(PRESETS, "name string, vocab int, width int, layers int, heads int, kv_heads int, head_dim int, context int")


_PRESET_SQL = "(select *, ((width * 8 // 3 + 63) // 64) * 64 as h, kv_heads * head_dim as kv from (values " + ", ".join(f"('{p[0]}', {', '.join(map(str, p[1:]))})" for p in PRESETS) + ") t(name, vocab, width, layers, heads, kv_heads, head_dim, context))"
_TOTALS = f"(select *, layers * (2 * width * heads * head_dim + 2 * width * kv + 2 * head_dim + 3 * width * h + 2 * width) as blocks from {_PRESET_SQL})"


@query("a31_model_sizes", f"select name, (vocab * width + blocks + width)::bigint as total, (2 * layers * context * kv * 2)::bigint as kv_bytes, (6 * (blocks + width) + 12 * layers * width * context)::bigint as flops_per_token from {_TOTALS}")
def a31(spark, sf):
    return schedules.model_sizes(_presets(spark)).select("name", "total", "kv_bytes", "flops_per_token")


@query("a30_token_budget", f"select name, (20 * (vocab * width + blocks + width))::bigint as optimal, round(20.0::double * (vocab * width + blocks + width) / {CORPUS_TOKENS}, 6) as epochs, case when 20.0 * (vocab * width + blocks + width) / {CORPUS_TOKENS} <= 1.5 then 'data-rich' when 20.0 * (vocab * width + blocks + width) / {CORPUS_TOKENS} <= 5 then 'well matched' else 'data-starved' end as verdict from {_TOTALS}")
def a30(spark, sf):
    sizes = schedules.model_sizes(_presets(spark)).withColumn("optimal", F.col("total") * 20)
    epochs = F.col("optimal") / F.lit(float(CORPUS_TOKENS))
    return sizes.select("name", "optimal", F.round(epochs, 6).alias("epochs"), schedules.budget_verdict(epochs).alias("verdict"))


@query("a32_corpus_plan", "with t as (select sum(length(text) + 1)::bigint as n from documents) select n as n_tokens, (n - 1) // 1024 as n_windows, 131072::bigint as tokens_per_step, round(6000 * 131072.0::double / n, 6) as epochs from t")
def a32(spark, sf):
    t = table(spark, sf, "documents").agg(F.sum(F.length("text") + 1).cast("long").alias("n_tokens"))
    return t.select("n_tokens", F.floor((F.col("n_tokens") - 1) / 1024).alias("n_windows"), F.lit(131072).cast("long").alias("tokens_per_step"), F.round(6000 * 131072.0 / F.col("n_tokens"), 6).alias("epochs"))


@query("s12_listing", "select p_name || '-' || p_partkey as name, case when p_partkey % 7 = 0 then -1 else p_size end::bigint as size from part")
def s12(spark, sf):
    size = F.when(F.col("p_partkey") % 7 == 0, "dir").otherwise(F.col("p_size").cast("string"))
    lines = table(spark, sf, "part").select(F.concat(F.lit("│ "), "p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" │ file │ "), size, F.lit(" │")).alias("line"))
    return item_sources.listing(lines).select("name", "size")


@query("j08_replace_row", "select n_nationkey, n_name, case when n_name = (select min(n_name) from nation) then 99 else n_regionkey end as n_regionkey from nation")
def j08(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    first = nation.agg(F.min(F.struct("n_name", "n_nationkey")).alias("f")).select(F.col("f.n_nationkey").alias("n_nationkey"), F.col("f.n_name").alias("n_name"), F.lit(99).alias("n_regionkey"))
    return compare.replace_row(nation, first, "n_name")


@query("j09_to_upload", "select 'f' || p_partkey as name, p_size::bigint as size from part where p_partkey % 3 <> 0 or p_size % 2 = 1")
def j09(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")
    local = part.select(name, F.col("p_size").cast("long").alias("size"))
    remote = part.where("p_partkey % 3 = 0").select(name, (F.floor(F.col("p_size") / 2) * 2).alias("size"))
    return compare.to_upload(local, remote)


@query("f14_config", "select 8 as batch, 2048 as max_seq_len, 768 as d_model")
def f14(spark, sf):
    """Unknown keys are ignored, the shape is the checkpoint's and the length is cut to its context."""
    config = sinks.read_config('{"batch": 8, "max_seq_len": 4096, "mystery": 1}', {"batch": 1, "max_seq_len": 512, "d_model": 64})
    config = sinks.inherit(config, {"d_model": 768, "max_seq_len": 2048})
    return spark.createDataFrame([(config["batch"], config["max_seq_len"], config["d_model"])], "batch int, max_seq_len int, d_model int")


@query("st_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_events(spark, sf):
    """The batch form of the streaming aggregate over event time."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")
