"""Filters and penalties on next-token scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def penalty_signed(logit: Column, seen: Column, penalty: float) -> Column:
    """Seen tokens lose: positive scores are divided, negative ones multiplied."""
    return F.when(seen & (logit > 0), logit / penalty).when(seen, logit * penalty).otherwise(logit)


def penalty_divided(logit: Column, seen: Column, penalty: float) -> Column:
    """Seen tokens are divided whatever their sign."""
    return F.when(seen, logit / penalty).otherwise(logit)


def top_k(scores: DataFrame, group: str, k: int, score: str = "logit") -> DataFrame:
    """Scores of the k best of each group; ties at the threshold are kept."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(score)))).where(F.col("rank") <= k).drop("rank")


def nucleus(scores: DataFrame, group: str, p: float, probability: str = "p", tie: str = "token") -> DataFrame:
    """Tokens whose mass strictly before them is at most p."""
    before = Window.partitionBy(group).orderBy(F.desc(probability), tie).rowsBetween(Window.unboundedPreceding, -1)
    return scores.withColumn("before", F.coalesce(F.sum(probability).over(before), F.lit(0.0))).where(F.col("before") <= p).drop("before")


def argmax(scores: DataFrame, group: str, score: str, index: str) -> DataFrame:
    """The first best of each group, by one aggregation and no sort."""
    return scores.groupBy(group).agg(F.max_by(F.struct(index, score), F.struct(F.col(score), -F.col(index))).alias("b")).select(group, f"b.{index}", f"b.{score}")


def top_members(scores: DataFrame, group: str, k: int, score: str = "logit", tie: str = "token") -> DataFrame:
    """Adds in_top: whether the row is among exactly ``k`` rows of its group, ties in the order of ``tie``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scores.withColumn("in_top", place <= k)


def multinomial(scores: DataFrame, group: str, score: str, index: str, uniform: Column, temperature: float) -> DataFrame:
    """One row of each group, drawn with probabilities softmax(score / temperature); the best one at temperature 0 or below.

    ``uniform`` are numbers between 0 and 1, both excluded, one of each row: by
    a seeded hash of its keys the draw is the same on every run.  The largest
    score plus Gumbel noise is such a draw, so no running sums are needed.
    """
    if temperature <= 0:
        return argmax(scores, group, score, index)
    noisy = scores.withColumn("_noisy", F.col(score) / temperature - F.log(-F.log(uniform)))
    return argmax(noisy, group, "_noisy", index).select(group, index)
