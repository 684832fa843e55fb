"""Same or nearly same records across the two sides of a split build.

Records are canonicalised (lower case, letters and digits, no matter the white
space and order) and hashed: equal hashes are equal records, a join of classes.
Hashes alone can't find nearly the same records, so the classes are also linked
by the near-duplicate search of ``neardup``; then classes and links are joined
with the classes on either side of each build.

The result is a row per document and build with numbers of counterparts, made
of counts by class: no pairs are formed, however often a text recurs.  Pairs
are expanded only where they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .neardup import near_duplicates


def assignments(builds: DataFrame, documents: DataFrame) -> DataFrame:
    """build_id, side, doc_id, source: distinct documents of the build's shard that a list names.

    Repeated builds, repeated indices and indices without a document leave no
    trace.  A null list or index assigns nothing.
    """
    lists = [builds.select("build_id", "shard_no", F.lit(side).alias("side"), F.explode(c).alias("doc_index")) for side, c in (("train", "train_doc_indices"), ("val", "val_doc_indices"))]
    listed = lists[0].unionByName(lists[1]).where("build_id is not null").distinct()
    return listed.join(documents.select("shard_no", "doc_index", "doc_id", "source"), ["shard_no", "doc_index"]).select("build_id", "side", "doc_id", "source").distinct()


@dataclass
class SplitOverlaps:
    """placed: build_id, side, doc_id, source, bag; links: bag_a < bag_b. Both as tables."""

    placed: DataFrame
    links: DataFrame

    def _linked(self) -> DataFrame:
        """bag, other of every link, both ways."""
        return self.links.select(F.col("bag_a").alias("bag"), F.col("bag_b").alias("other")).unionByName(self.links.select(F.col("bag_b").alias("bag"), F.col("bag_a").alias("other")))

    def documents(self) -> DataFrame:
        """build_id, side, doc_id, source, class_id, n_same, n_equal, n_near: counterparts of every listed document on the other side.

        ``n_same`` is 1 for a document on both sides; a text without words has
        no class and no other counterpart.
        """
        two = self.placed.groupBy("build_id", "doc_id").agg(F.count_distinct("side").alias("sides"))
        size = self.placed.where("bag is not null").groupBy("build_id", "side", "bag").agg(F.count_distinct("doc_id").alias("docs"))
        other = F.when(F.col("side") == "train", "val").otherwise("train").alias("side")
        equal = size.select("build_id", other, "bag", F.col("docs").alias("across"))
        near = size.join(self._linked(), "bag").groupBy("build_id", other, F.col("other").alias("bag")).agg(F.sum("docs").alias("n_near"))
        docs = self.placed.join(two, ["build_id", "doc_id"]).join(equal, ["build_id", "side", "bag"], "left").join(near, ["build_id", "side", "bag"], "left")
        same = (F.col("sides") == 2).cast("long")
        # a document on both sides is one of the class across, but no counterpart of another id
        return docs.select("build_id", "side", "doc_id", "source", F.col("bag").alias("class_id"), same.alias("n_same"), (F.greatest(F.coalesce("across", F.lit(0)) - same, F.lit(0))).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"))

    def report(self) -> DataFrame:
        """build_id, side, source, kind (same, equal, near), n_documents with a counterpart, n_pairs; from counts by class."""
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n")) for k in ("same", "equal", "near")))).alias("k")
        return self.documents().select("build_id", "side", "source", kinds).where("k.n > 0").groupBy("build_id", "side", "source", F.col("k.kind").alias("kind")).agg(F.count("*").alias("n_documents"), F.sum("k.n").alias("n_pairs"))

    def pairs(self) -> DataFrame:
        """build_id, train_doc, val_doc, kind, train_source, val_source: the counterparts expanded; a document on both sides pairs with itself."""
        train = self.placed.where("side = 'train'").select("build_id", F.col("doc_id").alias("train_doc"), F.col("bag").alias("train_bag"), F.col("source").alias("train_source"))
        val = self.placed.where("side = 'val'").select("build_id", F.col("doc_id").alias("val_doc"), F.col("bag").alias("val_bag"), F.col("source").alias("val_source"))
        columns = ["build_id", "train_doc", "val_doc", "train_source", "val_source"]
        equal = val.join(train, (val["build_id"] == train["build_id"]) & (val["val_bag"] == train["train_bag"])).drop(train["build_id"]).select(*columns)
        same = val.join(train, (val["build_id"] == train["build_id"]) & (val["val_doc"] == train["train_doc"])).drop(train["build_id"]).select(*columns)
        linked = self._linked().select(F.col("bag").alias("val_bag"), F.col("other").alias("train_bag"))
        nearly = val.join(linked, "val_bag").join(train, ["build_id", "train_bag"]).select(*columns)
        kinds = [d.withColumn("kind", F.lit(k)) for d, k in ((same, "same"), (equal.where("train_doc <> val_doc"), "equal"), (nearly, "near"))]
        return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()


def split_overlaps(documents: DataFrame, builds: DataFrame, threshold: float = 0.85) -> SplitOverlaps:
    """Documents of each build with their classes, and the links between classes of a shard.

    Empty tables give no rows; other columns are not read.
    """
    near = near_duplicates(documents, "doc_id", "text", group="shard_no", threshold=threshold)
    links = persist_table(near.links.select("bag_a", "bag_b"))
    placed = persist_table(assignments(builds, documents).join(near.members.select(F.col("id").alias("doc_id"), "bag"), "doc_id", "left"))
    return SplitOverlaps(placed, links)
