"""Vectorised words of Arrow text batches, as 64-bit hashes.

A word is a piece between spaces, tabs and line breaks, in lower case, reduced
to letters and digits; empty pieces are dropped.  Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_DROP = r"[^\p{L}\p{N} \t\r\n\v\f]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, id of each word in this batch, hash by id), in text order."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _DROP, "")
    parts = pc.ascii_split_whitespace(clean)
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    rows = np.repeat(np.arange(len(parts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    if "" in names:
        keep = ids != names.index("")
        rows, ids = rows[keep], ids[keep]
    return rows, ids, hashes


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of words: (row, token) of every occurrence, then bag hash and size of each row.

    The k-th occurrence of a word is a token of its own, so that the overlap of
    two token sets is the number of shared words counted with multiplicity.
    """
    rows, ids, hashes = word_ids(texts)
    order = np.argsort(rows * max(1, len(hashes)) + ids)
    rows, ids = rows[order], ids[order]
    at = np.arange(len(rows))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
    with np.errstate(over="ignore"):
        tokens = mix(hashes[ids] + nth.astype(np.uint64) * _MIX) if len(at) else np.zeros(0, np.uint64)
        n = np.bincount(rows, minlength=len(texts))
        bag = np.zeros(len(texts), np.uint64)
        if len(at):
            # rows are sorted: sums of runs, modulo 2^64
            bag[n > 0] = np.add.reduceat(mix(tokens ^ _MIX), (np.cumsum(n) - n)[n > 0])
    return rows, tokens, bag, n
