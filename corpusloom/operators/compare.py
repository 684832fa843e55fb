"""Joins that check, compare and update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import previous


def unassigned(docs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    return docs.join(assigned, key, "left_anti")


def on_both(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    return train.select(key).intersect(val.select(key))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with a column side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def verdict(new: Column, old: Column, lower_is_better: bool = True) -> Column:
    """better, same or worse; "not measured" if either is null."""
    gain = old - new if lower_is_better else new - old
    return F.when(new.isNull() | old.isNull(), "not measured").when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")


def compare_reports(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer by key: new, old, delta, verdict."""
    n, o = new.select(key, F.col(value).alias("new")), old.select(key, F.col(value).alias("old"))
    return n.join(o, key, "full").select(key, "new", "old", (F.col("new") - F.col("old")).alias("delta"), verdict(F.col("new"), F.col("old")).alias("verdict"))


def replace_row(board: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of the board, those named in the update replaced; fails if an update matches not exactly one row."""
    hits = update.join(board.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    wrong = F.raise_error(F.concat(F.lit("no single row named "), F.col(key).cast("string")))
    checked = hits.withColumn(key, F.when(F.coalesce("_n", F.lit(0)) != 1, wrong.cast(dict(update.dtypes)[key])).otherwise(F.col(key))).drop("_n")
    return board.join(update.select(key), key, "left_anti").unionByName(checked.select(*board.columns))


def to_upload(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files (name, size) that are missing remotely or differ in size."""
    return local.join(remote.select("name", F.col("size").alias("remote_size")), "name", "left").where(F.col("remote_size").isNull() | (F.col("remote_size") != F.col("size"))).drop("remote_size")


def first_below(curve: DataFrame, bar: DataFrame, step: str, loss: str) -> DataFrame:
    """The first step whose loss is below the one row of ``bar``."""
    return curve.crossJoin(F.broadcast(bar.select(F.col(loss).alias("_bar")).limit(1))).where(F.col(loss) < F.col("_bar")).agg(F.min(step).alias("first_step"))


def array_parity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, same, first_difference: whether two arrays agree, and the 0-based place of the first element that differs or is missing in one of them."""
    x, y = F.col(a), F.col(b)
    apart = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
    same = x.eqNullSafe(y)
    return pairs.select(key, same.alias("same"), F.when(~same, F.when(apart > 0, apart - 1).otherwise(F.least(F.size(x), F.size(y)))).cast("int").alias("first_difference"))


def offset_check(index: DataFrame, key: str) -> DataFrame:
    """One row: n_falling, n_gaps, last_end of an index with start_byte and end_byte: starts below the one before, starts that aren't the end before, and the largest end.

    Rows are compared across the borders of partitions too; no window takes all of them.
    """
    steps = previous(index.select(key, F.struct("start_byte", "end_byte").alias("_own")), key, "_own", "_before")
    own, before = F.col("_own"), F.col("_before")
    return steps.agg(F.count_if(own["start_byte"] < before["start_byte"]).alias("n_falling"), F.count_if(own["start_byte"] != F.coalesce(before["end_byte"], F.lit(0))).alias("n_gaps"), F.max(own["end_byte"]).alias("last_end"))
