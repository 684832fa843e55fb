"""Vocabularies of subword models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONTROL_TOKENS
from .prefix import ranked

#: Fixed value: the mark of a word's start.
WORD_MARK = "▁"


def classify(pieces: DataFrame) -> DataFrame:
    """Adds kind: unknown, control, byte, user-defined or normal, the first that holds."""
    p = F.col("piece")
    return pieces.withColumn("kind", F.when(p == "<unk>", "unknown").when(p.isin("<s>", "</s>", "<pad>"), "control").when(p.rlike("^<0x[0-9A-F]{2}>$"), "byte").when(p.startswith("<") & p.endswith(">"), "user-defined").otherwise("normal"))


def analysis(pieces: DataFrame) -> DataFrame:
    """kind, n, mean_length without the word mark, of each kind."""
    return classify(pieces).groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.length(F.replace("piece", F.lit(WORD_MARK), F.lit("")))).alias("mean_length"))


def characters(pieces: DataFrame) -> DataFrame:
    """Number of different characters of the normal pieces."""
    normal = classify(pieces).where("kind = 'normal'")
    return normal.select(F.explode(F.split(F.replace("piece", F.lit(WORD_MARK), F.lit("")), "")).alias("c")).where("c <> ''").agg(F.count_distinct("c").alias("n_characters"))


def best(pieces: DataFrame, k: int) -> DataFrame:
    return pieces.orderBy(F.desc("score"), "id").limit(k)


def merges(pieces: DataFrame) -> DataFrame:
    """piece_id, left_id, right_id, score, place for every split of a piece into two pieces: two joins with the vocabulary.

    ``place`` counts from 1 by falling score, then by the ids of piece, left and
    right half, which is the order in which a merging encoder tries them.
    """
    cut = pieces.where(F.length("piece") > 1).select(F.col("id").alias("piece_id"), "score", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("k"))
    parts = cut.select("piece_id", "score", F.expr("substring(piece, 1, k)").alias("l"), F.expr("substring(piece, k + 1)").alias("r"))
    left, right = pieces.select(F.col("piece").alias("l"), F.col("id").alias("left_id")), pieces.select(F.col("piece").alias("r"), F.col("id").alias("right_id"))
    found = parts.join(left, "l").join(right, "r").select("piece_id", "left_id", "right_id", "score")
    return ranked(found, F.desc("score"), "piece_id", "left_id", "right_id", out="place")


def protocol_problems(pieces: DataFrame) -> DataFrame:
    """piece, expected, actual of control tokens that are missing or have another id."""
    spark = pieces.sparkSession
    expected = spark.createDataFrame(list(CONTROL_TOKENS.items()), "piece string, expected int")
    return expected.join(pieces.select("piece", F.col("id").alias("actual")), "piece", "left").where("actual is null or actual <> expected")
