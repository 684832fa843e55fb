"""Statistics of lengths, samples, masks, vocabularies and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORE, LENGTH_RANGES
from ..functions.text import repetition_rate
from .prefix import ranked


def length_stats(docs: DataFrame, context: int = 4096, n: str = "n_tokens") -> DataFrame:
    """One row over all documents; means, deviation, extremes and quantiles are of the non-empty ones."""
    some = F.when(F.col(n) > 0, F.col(n))
    q = F.percentile(some, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95, 0.99))))
    row = docs.agg(
        F.count("*").alias("n_docs"),
        F.count(some).alias("n_nonempty"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_tokens"),
        F.avg(some).alias("mean"),
        F.stddev_pop(some).alias("std"),
        F.min(some).alias("min"),
        F.max(some).alias("max"),
        q.alias("q"),
        F.count_if(some > context).alias("n_over"),
    )
    named = [F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 95, 99))]
    return row.select("n_docs", "n_nonempty", "n_tokens", "mean", "std", "min", "max", *named, "n_over", (F.col("n_over") * 100.0 / F.nullif(F.col("n_nonempty"), F.lit(0))).alias("pct_over"))


def histogram(docs: DataFrame, bins: int = 20, n: str = "n_tokens") -> DataFrame:
    """bin, lo, hi, count, pct of the non-empty documents in equal widths; empty bins stay, the last one is closed."""
    some = docs.where(F.col(n) > 0)
    span = some.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.count("*").alias("all"))
    width = F.col("most") - F.col("least")
    at = F.when(width == 0, bins - 1).otherwise(F.least(F.floor((F.col(n) - F.col("least")) * bins / width), F.lit(bins - 1))).cast("int")
    counts = some.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    frame = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(span))
    full = frame.join(counts, "bin", "left")
    return full.select("bin", F.floor(F.col("least") + width * F.col("bin") / bins).alias("lo"), F.floor(F.col("least") + width * (F.col("bin") + 1) / bins).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) * 100.0 / F.col("all")).alias("pct"))


def range_buckets(docs: DataFrame, n: str = "n_tokens") -> DataFrame:
    """lo, count by fixed half-open ranges; ranges without documents stay."""
    at = F.lit(None).cast("int")
    for lo in LENGTH_RANGES:
        at = F.when(F.col(n) >= lo, F.lit(lo)).otherwise(at)
    counts = docs.where(F.col(n) >= LENGTH_RANGES[0]).groupBy(at.alias("lo")).agg(F.count("*").alias("count"))
    frame = docs.sparkSession.createDataFrame([(lo,) for lo in LENGTH_RANGES], "lo int")
    return frame.join(counts, "lo", "left").select("lo", F.coalesce("count", F.lit(0)).alias("count"))


def token_counts(docs: DataFrame, n: str = "n_tokens") -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"))


def label_counts(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """total, active, masked, ratio over all labels."""
    active = F.size(F.filter(labels, lambda x: x != IGNORE))
    return rows.agg(F.coalesce(F.sum(F.size(labels)), F.lit(0)).alias("total"), F.coalesce(F.sum(active), F.lit(0)).alias("active")).select("total", "active", (F.col("total") - F.col("active")).alias("masked"), F.coalesce(F.col("active") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def mask_report(labels: Column) -> Column:
    """n_tokens, n_active, n_masked, active_ratio, prompt_end (first active position, or the length)."""
    n, active = F.size(labels), F.size(F.filter(labels, lambda x: x != IGNORE))
    first = F.array_position(F.transform(labels, lambda x: x != IGNORE), True)
    return F.struct(n.alias("n_tokens"), active.alias("n_active"), (n - active).alias("n_masked"), F.coalesce(active / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("active_ratio"), F.when(first > 0, first - 1).otherwise(n).cast("int").alias("prompt_end"))


def audit(batches: DataFrame, batch: str, tokens: str, active: str, least: float = 0.05) -> DataFrame:
    """Totals over batches, fully masked batches, and whether the ratio is too low: batches first, then all."""
    per = batches.groupBy(batch).agg(F.sum(tokens).alias("t"), F.sum(active).alias("a"))
    row = per.agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_active"), F.count_if(F.col("a") == 0).alias("n_fully_masked"))
    ratio = F.coalesce(F.col("n_active") / F.nullif(F.col("n_tokens"), F.lit(0)), F.lit(0.0))
    return row.select("*", ratio.alias("ratio"), (F.col("n_fully_masked") > 0).alias("warn_masked"), (ratio < least).alias("warn_ratio"))


def repetition(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Mean share of repeated word 8-grams by group, with a total row of nulls."""
    return texts.withColumn("_rate", repetition_rate(text)).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_rate").alias("mean_repetition")) if not by else texts.withColumn("_rate", repetition_rate(text)).rollup(*by).agg(F.count("*").alias("n"), F.avg("_rate").alias("mean_repetition"))


def upper_median(values: DataFrame, value: str) -> DataFrame:
    """n, upper_median, max: the element at half the count of the sorted values, an existing one, by its rank. Nulls don't count; without values n is 0."""
    some = values.where(F.col(value).isNotNull()).select(value)
    n = some.agg(F.count("*").alias("n"), F.max(value).alias("max"))
    middle = ranked(some, value, out="_r").join(F.broadcast(n), F.col("_r") == F.floor(F.col("n") / 2) + 1).select(F.col(value).alias("upper_median"))
    return n.join(F.broadcast(middle), how="left").select("n", "upper_median", "max")


def change(new: Column, old: Column) -> tuple[Column, Column]:
    """(difference, percent); no percent where the old value is 0 or null."""
    return new - old, (new - old) * 100.0 / F.nullif(old, F.lit(0))
