"""Mixing sources to target weights by weighted fair queueing.

Every document (and every allowed repeat of it) gets a virtual finish time:
the tokens of its source up to it, in shuffled order, divided by the source's
weight.  The mixture is what finishes first, up to the token budget.  A source
that runs out of repeats leaves its share to the others in their proportions.

Running sums are made of sums of buckets of the shuffled order, which are as
many as the documents ask for, and of sums inside each; so no source is ever
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import load_byte_model
from ..session import persist_table

#: Documents to a bucket of the shuffled order; a source has as many buckets as that asks of all documents, each summed by one task.
BUCKET = 20_000


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file in /opt/tokenizers."""
    return f"/opt/tokenizers/{name}"


def count_tokens(texts: DataFrame, path: str) -> DataFrame:
    """Replace the column text by n_tokens; a null text has none. One tokenizer per Python worker."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text") + ", n_tokens long"
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_byte_model(path)
        for b in batches:
            out = b[rest].copy()
            out["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield out

    return texts.mapInPandas(run, schema)


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, source, copy (0-based), n_tokens, finish double.
    shares: source, target_share, share, n_tokens, n_rows, n_documents,
    available_tokens, most_copies.

    ``targets`` holds source, target_share, max_repeats; rows with a null or a
    share that isn't positive, and repeats of a source, are left out (the
    largest share of a source counts).  Documents of other sources, with a null
    source, or without tokens stay out; a repeated doc_id counts once.  The
    budget is the tokens of the sources together unless given.
    """
    goal = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats")
    wanted = documents.select("doc_id", "source", "text").join(goal.select("source"), "source", "left_semi")
    tokens = persist_table(count_tokens(wanted.where("doc_id is not null").select("doc_id", "source", "text"), path or tokenizer_file()))
    sized = tokens.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens").where("n_tokens > 0")
    place = F.xxhash64(F.lit(seed), "doc_id")
    bits = min(24, max(8, (tokens.count() // BUCKET).bit_length()))
    sized = sized.select("*", place.alias("place")).withColumn("bucket", F.shiftrightunsigned("place", 64 - bits).cast("int"))

    # two levels: sums of buckets, then running sums inside
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    sums = persist_table(sums)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = totals.join(goal, "source")
    if budget is None:
        budget = plan.agg(F.sum("available")).first()[0] or 0
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    once = sized.join(offsets.join(plan, ["source"]), ["source", "bucket"]).withColumn("upto", F.col("offset") + F.sum("n_tokens").over(inside))
    copies = once.select("doc_id", "source", "n_tokens", "available", "target_share", "upto", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("copy"))
    queue = persist_table(copies.select("doc_id", "source", "copy", "n_tokens", ((F.col("copy") * F.col("available") + F.col("upto")) / F.col("target_share")).alias("finish")))

    # the finish time at which the budget is used up, from the same buckets: no global sort is collected
    cut = _cut(queue, budget)
    mixture = queue.where(F.col("finish") <= cut)
    shares = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_documents"), F.max("copy").alias("last"))
    shares = goal.join(totals, "source", "left").join(shares, "source", "left")
    whole = mixture.agg(F.sum("n_tokens").alias("whole"))
    shares = shares.crossJoin(F.broadcast(whole)).select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("whole")).alias("share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("available", F.lit(0)).alias("available_tokens"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("most_copies"))
    return mixture, shares


def _cut(queue: DataFrame, budget: int, steps: int = 4, width: int = 4096) -> float:
    """The largest finish time up to which the queue holds at most ``budget`` tokens.

    Histograms of tokens by finish time, each over one cell of the one before;
    only their fixed number of cells comes to the driver.
    """
    queue = queue.select("finish", "n_tokens")
    top = queue.agg(F.max("finish").alias("m"), F.sum("n_tokens").alias("t")).first()
    if top["t"] is None or top["t"] <= budget:
        return float("inf")
    lo, hi, used = 0.0, float(top["m"]) * (1 + 1e-12), 0
    for _ in range(steps):
        step = (hi - lo) / width
        if step <= abs(hi) * 1e-15:
            break
        cells = queue.where((F.col("finish") > lo) & (F.col("finish") <= hi)).groupBy(F.least(F.floor((F.col("finish") - lo) / step), F.lit(width - 1)).alias("c")).agg(F.sum("n_tokens").alias("t"), F.min("finish").alias("a"), F.max("finish").alias("b")).orderBy("c").collect()
        for cell in cells:
            if used + cell["t"] > budget:
                break
            used, lo = used + cell["t"], cell["b"]
        if cell["a"] == cell["b"]:
            break
        hi = cell["b"]
        lo = max(lo, float(cell["a"]) * (1 - 1e-15)) if lo < cell["a"] * (1 - 1e-15) else lo
    return lo
