"""Connected groups of linked classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, persist_table


def connected(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its group) for the nodes of links(a, b); null ends and loops are left out.

    Alternates large-star and small-star steps until the edges stay the same;
    every step is written out, so lineage stays short and no group is held by
    one task.  The number of rounds grows with the logarithm of the longest
    path; rounds go on until nothing changes, and tables of past rounds are
    deleted.
    """
    edges = persist_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        past = edges
        # large star: larger neighbours of a node to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = persist_table(large.where("a <> b").distinct())
        drop_table(past)
        # small star: a node and its smaller neighbours to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = persist_table(small.where("a <> b").distinct())
        drop_table(large)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    nodes = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = edges.select(F.col("b").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return nodes.unionByName(roots)
