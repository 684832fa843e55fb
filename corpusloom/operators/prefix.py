"""Running totals, ranks and exact-count marks without a single-task window.

Rows are sorted by range partitions and written with their places, so any order
on any columns works, however the keys are spread.  Only a row per partition is
ever added up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table

_IN_PART = 33


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` as a table with ``__part`` and ``_at``: range partitions of the order, and places that rise with it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return persist_table(placed).withColumn("__part", F.shiftright("__at", _IN_PART))


def _before_part(per_part: DataFrame, value: Column) -> DataFrame:
    """__part, __prior: an aggregate over the parts before; there are as many rows as partitions, so one window takes them."""
    return F.broadcast(per_part.select("__part", value.over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__prior")))


def running_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, by ``key``.

    Rows of one key have no order among them; a null value counts 0, rows with
    a null key come first.
    """
    placed = in_order(df, key)
    offsets = _before_part(placed.groupBy("__part").agg(F.sum(value).alias("_sum")), F.sum("_sum"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, "__part").withColumn(out, F.coalesce("__prior", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__at", "__prior")


def least_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the smallest ``value`` of the rows before, null for the first; null values don't count."""
    placed = in_order(df, order)
    offsets = _before_part(placed.groupBy("__part").agg(F.min(value).alias("_min")), F.min("_min"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, "__part").withColumn(out, F.least("__prior", F.min(value).over(inside))).drop("__part", "__at", "__prior")


def previous(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the ``value`` of the row before, null for the first one; the last row of a part is handed to the next part with rows."""
    placed = in_order(df, order)
    # a struct, as the value handed over may be null
    last = _before_part(placed.groupBy("__part").agg(F.max_by(F.struct(F.col(value).alias("v")), "__at").alias("_last")), F.last("_last"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("__part").orderBy("__at"))
    return placed.join(last, "__part").withColumn(out, F.coalesce(inside, F.col("__prior"))["v"]).drop("__part", "__at", "__prior")


def ranked(df: DataFrame, *order: str | Column, out: str) -> DataFrame:
    """Adds ``out``: the 1-based place in the order. Rows that tie get places in any order, so end the order with a unique column."""
    placed = in_order(df, *order)
    offsets = _before_part(placed.groupBy("__part").agg(F.count("*").alias("_n")), F.sum("_n"))
    at = F.col("__at").bitwiseAND(F.lit((1 << _IN_PART) - 1)) + 1
    return placed.join(offsets, "__part").withColumn(out, F.coalesce("__prior", F.lit(0)) + at).drop("__part", "__at", "__prior")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: n, and q0, q1, ... interpolated between the two values beside each share's place. Null values don't count; without values all are null."""
    places = ranked(df.where(F.col(value).isNotNull()).select(value), value, out="_r")
    n = df.agg(F.count(value).alias("n"))
    rows = places.crossJoin(F.broadcast(n))
    pick = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(place) + 1, F.ceil(place) + 1
        pick += [F.max(F.when(F.col("_r") == lo, F.col(value))).alias(f"_lo{i}"), F.max(F.when(F.col("_r") == hi, F.col(value))).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    return rows.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), *pick).select("n", *(((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))).alias(f"q{i}") for i in range(len(shares))))


def mark_smallest(df: DataFrame, hashed: Column, tie: str, wanted: Column, out: str) -> DataFrame:
    """Adds ``out``: whether the row is among the ``wanted`` (of all rows) smallest by the hex string ``hashed``, then ``tie``.

    Rows are counted by the first four digits, so the window over counts has at
    most 65,536 rows; only the cell in which the limit lies is ranked.
    """
    cells = df.withColumn("_h", hashed).withColumn("_cell", F.substring("_h", 1, 4))
    counts = cells.groupBy("_cell").agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("n_all")).select("n_all", wanted.cast("long").alias("_wanted"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_cell")))
    edge = upto.crossJoin(F.broadcast(totals)).select("_cell", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"), "_n")
    marked = cells.join(F.broadcast(edge), "_cell")
    inside = Window.partitionBy("_cell").orderBy("_h", tie)
    # cells before and after the edge need no rank
    split = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    some = marked.where(split).withColumn(out, F.row_number().over(inside) <= F.col("_take"))
    rest = marked.where(~split).withColumn(out, F.col("_take") > 0)
    return some.unionByName(rest).drop("_h", "_cell", "_take", "_n")
