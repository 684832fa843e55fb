"""Passages of evaluation items inside corpus documents, by winnowing.

Words of documents and items are hashed; of every window of ``W`` consecutive
``K``-word grams the smallest hash is kept as a fingerprint on both sides, so
any shared span of ``K + W - 1`` words has a common fingerprint.  Of items so
short that half of them with ``FEW`` changed words may hold no such span, every
gram is a fingerprint, on both sides.  Documents and items that share one are
extended to whole passages: the longest common word sequence around each
cluster of shared grams.

Documents pass bit sets of the items' fingerprints and grams first: grams of
items that lie too far from others to make up a passage of any item end there.
The sets have a fixed size, whatever the number of items; the join that follows
is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .pruning import pruned
from .words import mix, word_ids

K, W = 3, 3
BITS = 24
#: Words between shared grams that still belong to one passage.
GAP = 12
#: Changed words that half of an item may have and still be sure of a common fingerprint.
FEW = 3
#: Words before the first and after the last shared gram that may belong to a passage.
EDGE = 3
#: Words at each end of a passage that may be changed and thus lie outside its shared grams.
LOOSE = 1


def grams(hashes: np.ndarray, rows: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position, and whether they lie in one text."""
    m = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(31) + hashes[i : i + m])
    return h, rows[:m] == rows[k - 1 : k - 1 + m] if m else np.zeros(0, bool)


def winnow(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the smallest gram of every window, all grams of texts shorter than a window."""
    h, ok = grams(hashes, rows)
    if not len(h):
        return np.zeros(0, np.int64)
    top = np.uint64(2**64 - 1)
    h = np.where(ok, h, top)
    m = len(h) - W + 1
    if m < 1:
        return np.flatnonzero(ok)
    stack = np.stack([h[i : i + m] for i in range(W)])
    # a window that leaves its text is no window; shorter texts keep all their grams
    inside = rows[:m] == rows[W + K - 2 : W + K - 2 + m]
    picked = np.unique((np.arange(m) + stack.argmin(axis=0))[inside])
    size = np.bincount(rows)
    short = np.flatnonzero(ok & (size[rows[: len(h)]] < K + W - 1))
    return np.union1d(picked, short)


def _item_words(texts: pd.Series) -> list[list[int]]:
    rows, ids, hashes = word_ids(pa.array(texts, pa.string()))
    h = hashes[ids].view(np.int64)
    cut = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [h[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def standard_questions(ctx: Column | str = "ctx") -> Column:
    """The last sentence of a ctx, for counting."""
    return F.regexp_extract(F.trim(ctx), r"(?:^|[.!?]\s+)([^.!?]*[.!?])$", 1)


def item_words(items: DataFrame, repeated: int = 3) -> DataFrame:
    """item_id, words array<long> of each item, without a closing sentence that ``repeated`` items or more share."""
    spark = items.sparkSession
    base = items.where("item_id is not null and ctx is not null").groupBy("item_id").agg(F.min("ctx").alias("ctx")).withColumn("last", standard_questions())
    common = base.groupBy("last").count().where(F.col("count") >= repeated).where("last <> ''").select("last", F.lit(True).alias("standard"))
    cut = base.join(common, "last", "left").select("item_id", F.when(F.col("standard"), F.expr("substr(trim(ctx), 1, length(trim(ctx)) - length(last))")).otherwise(F.col("ctx")).alias("ctx"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": _item_words(b["ctx"])})

    return persist_table(cut.select(F.col("item_id").cast("long").alias("item_id"), "ctx").mapInPandas(run, "item_id long, words array<long>"))


def is_short(n: int) -> bool:
    """Whether half of n words, ``FEW`` of them changed, may hold no span of ``K + W - 1`` words."""
    return (n + 1) // 2 - FEW < (FEW + 1) * (K + W - 2) + 1


def _item_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i, words in zip(b["item_id"], b["words"], strict=True):
            h = np.array(words, np.int64).view(np.uint64)
            rows = np.zeros(len(h), np.int64)
            g, short = grams(h, rows)[0], is_short(len(h))
            picked = np.isin(g, g[winnow(h, rows)]) | short
            yield pd.DataFrame({"item_id": i, "n": len(h), "short": short, "print": g.view(np.int64), "picked": picked})


def _bit_set(prints: DataFrame) -> np.ndarray:
    cells = prints.select((F.shiftrightunsigned("print", 64 - BITS)).cast("int").alias("cell")).distinct().toArrow()["cell"].to_numpy()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    return bits


def _known(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cell = g >> np.uint64(64 - BITS)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _within_long(at: np.ndarray, known: np.ndarray, rows: np.ndarray, width: int, count: int) -> np.ndarray:
    """Those of the positions ``at`` whose cluster of ``known`` positions, which hold them, has ``count`` of these within ``width`` words somewhere."""
    if not len(known):
        return at[:0]
    new = np.r_[True, (np.diff(rows[known]) != 0) | (np.diff(known) > GAP)]
    cluster = np.cumsum(new) - 1
    ahead = max(0, count - 1)
    begin = np.arange(max(0, len(known) - ahead))
    dense = (known[begin + ahead] - known[begin] + K <= width) & (cluster[begin + ahead] == cluster[begin])
    good = np.zeros(cluster[-1] + 1, bool)
    good[cluster[begin[dense]]] = True
    return at[good[np.searchsorted(known[new], at, "right") - 1]]


def least_grams(n: int, share: float, density: float) -> tuple[int, int]:
    """(words, grams): somewhere in every passage of an item of ``n`` words or more so many of its grams lie within so many words.

    The shortest passage has ``words`` words.  In it, and in the better end of
    a longer one, one word in ``1 / (1 - density)`` is changed or added, and
    each of these takes ``K`` grams away.
    """
    words = math.ceil(share * n - 1e-9)
    return words, max(1, words - (K - 1) - K * math.ceil(words * (1 - density) - 1e-9))


def _document_prints(bits, all_bits, width: int, count: int, short_bits=None):
    """Fingerprints of documents that items may have.

    ``all_bits`` are all grams of the longer items: fingerprints whose cluster
    of such grams nowhere has ``count`` of them within ``width`` words can't be
    part of a passage of any of them.  ``short_bits`` are the grams of short items, if there are any;
    these are kept wherever they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, hashes = word_ids(b.column("text"))
            h = hashes[ids]
            g, ok = grams(h, rows)
            known = np.flatnonzero(ok & _known(g, all_bits.value))
            at = winnow(h, rows)
            at = _within_long(at[_known(g[at], bits.value) & _known(g[at], all_bits.value)], known, rows, width, count)
            if short_bits is not None:
                at = np.union1d(at, np.flatnonzero(ok & _known(g, short_bits.value)))
            pairs = np.unique(np.stack([rows[at], g[at].view(np.int64)]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(pairs[0])), pa.array(pairs[1])], names=["doc_id", "print"])

    return run


def sequence_lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequence of a and the first 1, 2, ... elements of b, on bits of one integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, n, out = full, 0, []
    for x in b:
        m = at.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            n = len(a) - v.bit_count()
        out.append(n)
    return out


def common_sequence(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    return sequence_lengths(a, b)[-1] if b else 0


def _best_end(item: list, text: list, price: float) -> list:
    """The text from its first shared word to the end that pays best, if each word costs ``price`` and each shared one brings 1."""
    lengths = sequence_lengths(item, text)
    begin = next((i for i, n in enumerate(lengths) if n), len(text))
    best, at = 0.0, begin
    for i, n in enumerate(lengths[begin:], 1):
        if n - price * i > best:
            best, at = n - price * i, begin + i
    return text[begin:at]


def passage_in(item: list, text: list, price: float = 0.65) -> tuple[int, int, int]:
    """(shared words, words of the passage, words of the item from its first to its last shared word) of the best passage of ``text``.

    Words before and after it that share too little with the item for their
    number are left out.
    """
    text = _best_end(item[::-1], _best_end(item, text, price)[::-1], price)[::-1]
    if not text:
        return 0, 0, 0
    lengths = sequence_lengths(text, item)
    shared = lengths[-1]
    item = item[: lengths.index(shared) + 1]
    return shared, len(text), sequence_lengths(text[::-1], item[::-1]).index(shared) + 1


def clusters(doc: np.ndarray, doc_rows: np.ndarray, item: np.ndarray, item_rows: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document row, item row, first word, word after the last, item words covered) of each cluster of shared grams.

    All pairs at once.  ``wanted`` holds document row times ``size``, the number of items, plus item row.
    """
    (dg, dok), (ig, iok) = grams(doc, doc_rows), grams(item, item_rows)
    dpos, ipos = np.flatnonzero(dok), np.flatnonzero(iok)
    ipos = ipos[np.argsort(ig[ipos], kind="stable")]
    known = ig[ipos]
    lo = np.searchsorted(known, dg[dpos])
    n = np.searchsorted(known, dg[dpos], "right") - lo
    at = np.repeat(dpos, n)
    of = ipos[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(at))]
    key = doc_rows[at] * size + item_rows[of]
    keep = np.isin(key, wanted)
    at, of, key = at[keep], of[keep], key[keep]
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    order = np.lexsort((at, key))
    at, of, key = at[order], of[order], key[order]
    start = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(at) > GAP)])
    first, last = at[start], at[np.r_[start[1:], len(at)] - 1]
    covered = np.maximum.reduceat(of, start) + K - np.minimum.reduceat(of, start)
    return key[start] // size, key[start] % size, first, last + K, covered


def passages(texts: pa.Array, item_words: pa.ListArray, wanted: np.ndarray, share: float, density: float) -> dict[int, tuple[float, float]]:
    """By pair of ``wanted``, (share of the item, density of shared words) of the best passage that spans and shares enough.

    A passage spans the item from its first to its last shared word, changed
    words included.  A cluster is left out only if the words it can reach are
    fewer than that asks for.
    """
    rows, ids, hashes = word_ids(texts)
    h = hashes[ids]
    lengths = np.diff(item_words.offsets.to_numpy())
    item = item_words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    item_rows = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    starts = np.cumsum(lengths) - lengths
    size = len(lengths)
    d, i, a, b, covered = clusters(h, rows, item, item_rows, size, wanted)
    n = lengths[i]
    far = (b - a + 2 * EDGE >= density * share * n) & (covered + 2 * EDGE + 2 * LOOSE >= share * n)
    out: dict[int, tuple[float, float]] = {}
    for x in np.flatnonzero(far).tolist():
        words, size_of_item = item[starts[i[x]] : starts[i[x]] + n[x]].tolist(), int(n[x])
        key, begin, end = int(d[x]) * size + int(i[x]), int(ends[d[x]]), int(ends[d[x] + 1])
        shared, length, span = passage_in(words, h[max(begin, int(a[x]) - EDGE) : min(end, int(b[x]) + EDGE)].tolist())
        # a single gram is a phrase, unless it is the item
        if not length or shared <= K and shared < size_of_item:
            continue
        s, dn = shared / size_of_item, shared / length
        if dn >= density and s >= density * share and span + 2 * LOOSE >= share * size_of_item and dn * s > out.get(key, (0.0, 0.0))[0] * out.get(key, (0.0, 0.0))[1]:
            out[key] = (s, dn)
    return out


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, density: float = 0.8) -> DataFrame:
    """doc_id, item_id, share, density: documents that carry half of an item's words as one passage.

    A passage spans ``share`` of the item, changed words included, and
    ``density`` of its own words are the item's, in order.  Items built alike
    share up to half of their words in order, but with changes all over.  Every
    pair with a common fingerprint is extended.  Three words alone are a phrase
    and no passage, unless they are the item; items of one or two words have no
    gram and leak nothing.  Null and
    empty texts and items have no words and leak nothing; rows repeated under
    one id count once.  Other columns are not read.
    """
    spark = documents.sparkSession
    words = item_words(items)
    all_grams = persist_table(words.mapInPandas(_item_prints, "item_id long, n int, short boolean, print long, picked boolean").distinct())
    prints = all_grams.where("picked").select("item_id", "print")
    long, shorter = all_grams.where("not short"), all_grams.where("short")
    bits, all_bits = (spark.sparkContext.broadcast(_bit_set(x)) for x in (long.where("picked"), long))
    short_bits = spark.sparkContext.broadcast(_bit_set(shorter)) if shorter.head(1) else None
    width, count = least_grams(long.agg(F.min("n")).first()[0] or 0, share, density)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = texts.mapInArrow(_document_prints(bits, all_bits, width, count, short_bits), "doc_id long, print long")
    pairs = persist_table(found.join(prints, "print").select("doc_id", "item_id").distinct())

    joined = pruned(texts, "doc_id", pairs.select("doc_id").distinct()).join(pairs, "doc_id").join(words, "item_id").select("doc_id", "item_id", "text", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").dictionary_encode()
            of_text = text.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, first, of_item = np.unique(b.column("item_id").to_numpy(), return_index=True, return_inverse=True)
            wanted = of_text * len(ids) + of_item
            good = passages(text.dictionary, b.column("words").take(pa.array(first)), np.unique(wanted), share, density)
            at = np.flatnonzero(np.isin(wanted, list(good)))
            s, dn = (pa.array([good[k][j] for k in wanted[at].tolist()], pa.float64()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), b.column("item_id").take(pa.array(at)), s, dn], names=["doc_id", "item_id", "share", "density"])

    return joined.mapInArrow(verify, "doc_id long, item_id long, share double, density double").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("density").alias("density"))
