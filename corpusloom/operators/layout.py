"""Token streams: offsets, splits, windows, packing, batches and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EOS, IGNORE
from ..functions.text import let
from .prefix import mark_smallest, running_total


#: Tokens to a block of the stream, which one task cuts into windows.
BLOCK_TOKENS = 32_000_000


def offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, start_byte, end_byte in the order of the key; two bytes per token."""
    sized = docs.select(key, F.col("n_tokens").cast("long").alias("n_tokens"))
    return running_total(sized, key, "n_tokens", "_start").select(key, "n_tokens", (F.col("_start") * 2).alias("start_byte"), ((F.col("_start") + F.col("n_tokens")) * 2).alias("end_byte"))


def lengths(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token counts back from byte offsets."""
    return index.select(key, F.floor((F.col("end_byte") - F.col("start_byte")) / 2).cast("long").alias("n_tokens"))


def split_documents(docs: DataFrame, seed: int, ratio: float, key: str = "doc_id") -> DataFrame:
    """Adds is_val: the max(1, floor(n * ratio)) documents with the smallest hashes of seed and key."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return mark_smallest(docs, hashed, key, F.greatest(F.lit(1), F.floor(F.col("n_all") * ratio)), "is_val")


def load_split(train: DataFrame, val: DataFrame | None, ratio: float, seed: int, key: str, cap: int = 0) -> DataFrame:
    """Samples with is_val: those of a validation table if there is one, else of a split of the training table.

    ``cap`` takes the first samples by the key, max(1, floor(cap * ratio)) of
    them for validation; 0 takes all.
    """
    first = lambda df, n: df if cap <= 0 else df.orderBy(key).limit(n)
    val_cap = max(1, int(cap * ratio))
    if val is not None:
        return first(train, cap).withColumn("is_val", F.lit(False)).unionByName(first(val, val_cap).withColumn("is_val", F.lit(True)))
    if cap <= 0:
        return split_documents(train, seed, ratio, key)
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return mark_smallest(first(train, cap), hashed, key, F.greatest(F.lit(1), F.floor(F.col("n_all") * ratio)), "is_val")


def _stream(docs: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
    """(documents with their block of the stream, side by side and in order; first token of each block).

    Blocks are ranges of the key, a unique integer.  Their borders and sizes
    come from keys and lengths alone, so the tokens are shuffled once.
    Documents with a null key or null tokens are left out.
    """
    docs = docs.where(F.col(key).isNotNull() & F.col("tokens").isNotNull())
    sized = running_total(docs.select(key, F.size("tokens").cast("long").alias("_n")), key, "_n", "_start")
    total = sized.agg(F.max(F.col("_start") + F.col("_n"))).first()[0] or 0
    wide = max(1, min(BLOCK_TOKENS, -(-total // docs.sparkSession.sparkContext.defaultParallelism)))
    # a row per block comes to the driver
    parts = sized.groupBy(F.floor(F.col("_start") / wide).alias("_b")).agg(F.min(key).alias("first"), F.sum("_n").alias("n")).orderBy("_b").collect()
    firsts = np.array([r["first"] for r in parts[1:]], np.int64)
    begins = np.cumsum([0, *(r["n"] for r in parts)])

    @F.pandas_udf("int")
    def block(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, keys.to_numpy(np.int64), "right").astype(np.int32))

    placed = docs.select(key, block(F.col(key)).alias("_block"), F.col("tokens").cast("array<int>").alias("tokens"))
    return placed.repartitionById(max(1, len(parts)), "_block").sortWithinPartitions("_block", key), begins


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(block, its next tokens, whether they are the last ones)."""
    before = None
    for b in batches:
        block, lists = b.column("_block").to_numpy(zero_copy_only=False), b.column("tokens")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if before is not None:
                yield *before, bool(before[0] != block[i])
            before = int(block[i]), flat[offsets[i] : offsets[j]].copy()
    if before is not None:
        yield *before, True


def _arrow_windows(window: np.ndarray, at: np.ndarray, parts: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(window.astype(np.int64)), pa.array(at.astype(np.int64)), parts], names=["window_id", "at", "part"])


def _whole(begins: np.ndarray, size: int, overlap: int):
    """Windows that lie in one block."""
    wide = size + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at, block = np.zeros(0, np.int32), 0, -1
        for b, tokens, _ in _blocks(batches):
            if b != block:
                block, at, kept = b, int(begins[b]), np.zeros(0, np.int32)
            kept = np.concatenate([kept, tokens])
            first = -(-at // size)
            n = max(0, (at + len(kept) - wide) // size - first + 1) if at + len(kept) >= wide else 0
            if n:
                starts = (first + np.arange(n)) * size
                flat = kept[((starts - at)[:, None] + np.arange(wide)).ravel()]
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * wide)
                yield _arrow_windows(first + np.arange(n), starts, pa.ListArray.from_arrays(offsets, pa.array(flat)))
                done = (first + n) * size - at
                kept, at = kept[done:], at + done

    return run


def _edges(begins: np.ndarray, size: int, overlap: int):
    """Parts of windows that reach beyond their block: at most a window's width at each end of it."""
    wide = size + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail, block, seen = np.zeros(0, np.int32), np.zeros(0, np.int32), -1, 0
        for b, tokens, last in _blocks(batches):
            if b != block:
                head, tail, block, seen = np.zeros(0, np.int32), np.zeros(0, np.int32), b, 0
            if len(head) < 2 * wide:
                head = np.concatenate([head, tokens[: 2 * wide - len(head)]])
            tail = np.concatenate([tail, tokens])[-2 * wide :]
            seen += len(tokens)
            if not last or not seen:
                continue
            begin, end = int(begins[b]), int(begins[b]) + seen
            window, at, parts = [], [], []
            # all windows from the first to the last whole one lie in the block
            first, last_one = -(-begin // size), (end - wide) // size
            lowest, highest = max(0, (begin - wide) // size), (end - 1) // size
            beyond = [*range(lowest, first), *range(last_one + 1, highest + 1)] if last_one >= first else range(lowest, highest + 1)
            for w in beyond:
                lo, hi = max(begin, w * size), min(end, w * size + wide)
                if hi > lo:
                    near = head[lo - begin : hi - begin] if hi - begin <= len(head) else tail[lo - (end - len(tail)) : hi - (end - len(tail))]
                    window.append(w), at.append(lo), parts.append(near)
            if window:
                yield _arrow_windows(np.array(window), np.array(at), pa.array(parts, pa.list_(pa.int32())))

    return run


def _windows(docs: DataFrame, size: int, overlap: int, key: str) -> DataFrame:
    """window_id, tokens: windows of ``size`` tokens of the stream and ``overlap`` more; the last ones may be shorter.

    Most windows lie in one block of the stream and are cut from it; only those
    at the borders of blocks are put together from parts, whose list fits in a
    window.
    """
    placed, begins = _stream(docs, key)
    schema = "window_id long, at long, part array<int>"
    whole = placed.mapInArrow(_whole(begins, size, overlap), schema).select("window_id", F.col("part").alias("tokens"))
    edges = placed.mapInArrow(_edges(begins, size, overlap), schema)
    joined = edges.groupBy("window_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda s: s["part"])).alias("tokens"))
    return whole.unionByName(joined)


def shifted_windows(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """window_id, x, y of the stream: x the tokens of the window, y those one further; only whole windows."""
    whole = _windows(docs, size, 1, key).where(F.size("tokens") == size + 1)
    return whole.select("window_id", F.slice("tokens", 1, size).alias("x"), F.slice("tokens", 2, size).alias("y"))


def packed_windows(docs: DataFrame, size: int, key: str = "doc_id", pad: bool = False) -> DataFrame:
    """window_id, tokens: documents with an end token each, concatenated and cut every ``size`` tokens.

    The rest is dropped, or filled with end tokens if ``pad``.
    """
    ended = docs.withColumn("tokens", F.when(F.coalesce(F.try_element_at("tokens", F.lit(-1)) == EOS, F.lit(False)), F.col("tokens")).otherwise(F.concat("tokens", F.array(F.lit(EOS)))))
    windows = _windows(ended, size, 0, key)
    if pad:
        return windows.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(EOS), F.lit(size) - F.size("tokens"))))
    return windows.where(F.size("tokens") == size)


def document_runs(tokens: Column) -> Column:
    """Lengths of the documents in a window, each with its end token; the first one may have begun before."""
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t == EOS, i + 1)), lambda p: p.isNotNull())
    return let(
        F.concat(F.array(F.lit(0)), ends, F.array(F.size(tokens))),
        lambda cuts: F.filter(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda d: F.get(cuts, d + 1) - F.get(cuts, d)), lambda n: n > 0),
    )


def document_ids(tokens: Column) -> Column:
    """Number of the document of each position: it rises after an end token."""
    return F.flatten(F.transform(document_runs(tokens), lambda n, d: F.array_repeat(d, n)))


def visible_keys(tokens: Column) -> Column:
    """Keys that each position sees under the causal mask inside its document: those since the document's start, so no pair is formed."""
    return F.flatten(F.transform(document_runs(tokens), lambda n: F.sequence(F.lit(1), n)))


def visible_totals(windows: DataFrame) -> DataFrame:
    """window_id, doc, n, n_visible: positions of each document of a window and the entries of the mask they open."""
    runs = windows.select("window_id", F.posexplode(document_runs(F.col("tokens"))).alias("doc", "n"))
    n = F.col("n").cast("long")
    return runs.select("window_id", F.col("doc").cast("long").alias("doc"), n.alias("n"), F.expr("cast(n as bigint) * (n + 1) div 2").alias("n_visible"))


def padding_visible(mask: Column) -> Column:
    """Real keys at or before each position of a 1/0 mask, added up: a running count, no pairs of positions."""
    state = F.aggregate(
        mask,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("all")),
        lambda s, m: F.struct((s["seen"] + m).alias("seen"), (s["all"] + s["seen"] + m).alias("all")),
    )
    return state["all"]


def shift(tokens: Column) -> tuple[Column, Column]:
    """(inputs, targets): all but the last, all but the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, 1, n), F.when(n > 0, F.slice(tokens, 2, n)).otherwise(F.slice(tokens, 1, 0))


def shuffled(windows: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Adds shuffle_key, whose order is the epoch's order of the windows."""
    return windows.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), F.col("window_id").cast("string"))))


def batches(rows: DataFrame, index: str, size: int, drop_last: bool, world: int = 1, rank: int = 0) -> DataFrame:
    """Adds batch_id to rows with a dense 0-based index; ranks take every world-th row, train batches must be full."""
    mine = rows.where(F.col(index) % world == rank).withColumn("batch_id", F.floor(F.floor(F.col(index) / world) / size))
    if not drop_last:
        return mine
    full = mine.groupBy("batch_id").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("batch_id")
    return mine.join(full, "batch_id", "left_semi")


def collate(rows: DataFrame, batch: str, pad: int, limit: int | None = None) -> DataFrame:
    """Right-padded input_ids, labels and attention_mask of rows with input_ids and labels, to the width of their batch."""
    if limit is not None:
        rows = rows.withColumn("input_ids", F.slice("input_ids", 1, limit)).withColumn("labels", F.slice("labels", 1, limit))
    width = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_width"))
    wide = rows.join(width, batch).withColumn("_n", F.size("input_ids"))
    gap = F.col("_width") - F.col("_n")
    return wide.select(
        *[c for c in rows.columns if c not in ("input_ids", "labels")],
        F.concat("input_ids", F.array_repeat(F.lit(pad), gap)).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(IGNORE), gap)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def evenly_spread(n: int, want: int) -> list[int]:
    """Distinct positions floor(i * n / want)."""
    return sorted({i * n // want for i in range(want)}) if 0 < want < n else list(range(n))


def accumulation_groups(rows: DataFrame, batch: str, size: int, targets: str) -> DataFrame:
    """group_id, n_batches, n_targets of ``size`` batches each; groups without targets are left out."""
    return rows.groupBy(F.floor(F.col(batch) / size).alias("group_id")).agg(F.count_distinct(batch).alias("n_batches"), F.sum(targets).alias("n_targets")).where("n_targets > 0")
