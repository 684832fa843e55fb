"""Near-duplicate texts: adaptive multi-match prefixes over word multisets.

Two texts are linked when they share at least ``threshold`` of the words of the
longer one, counted with multiplicity and in any order.  The search is exact.

1. Texts with the same multiset of words form a class (any size, no pairs).
2. Tokens (word, k-th occurrence) are ordered by a count sketch over all texts,
   rarest first.  The sketch has a fixed number of cells, so its broadcast is
   bounded; cells only steer cost, any total order gives the same links.
3. A text whose prefix has only rare tokens is matched on single tokens.  One
   whose prefix has costly tokens gets its prefix lengthened by ``g`` tokens
   and must share ``g + 1`` of them: of ``g`` groups of tokens one then holds
   two shared ones, so costly tokens are matched in pairs within their group.
   Rare tokens of the longer prefix stay single, which also links texts of
   different levels: if all prefix tokens of one are rare, so is the shared one.
4. Each key carries the text's size and a 256-bit parity of its tokens.  Bits
   that differ bound the symmetric difference from below, so pairs that cannot
   reach the threshold end where they meet.  Texts of ``WIDE`` words or more,
   which may differ in more tokens than 256 bits can tell, carry 768 bits
   besides.  The rest is verified on tokens.
5. Rows are exchanged and sorted by key once and meet on Arrow batches: those
   of a key by size, each with the rows after it that aren't too long for it,
   so no pair is looked at twice.  Keys of more than ``HOT`` rows, as a
   template repeated with other values has them, are spread over blocks of that
   size, so no task meets more than ``HOT`` rows of a key with as many others.
6. Only the first text of a class is matched.  Keys of large tables are written
   once, a row a text, and meet in up to ``ROUNDS`` rounds, each of its share of
   the keys; what a round has shuffled is deleted before the next.

Null and empty texts have no words and are in no class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, persist_table, shuffles_released
from .pruning import pruned
from .words import bags, mix

CELL_BITS = 20
#: A token in at most so many texts is rare: matching on it alone is cheap.
RARE = 100
#: Rows of a key above which they are spread over blocks of so many.
HOT = 20_000
#: Words of texts for each of the tasks that match keys, if the session asks for fewer tasks.
WORDS_A_TASK = 2_000_000
#: Words of texts from which keys meet in one more round, and the most rounds.
WORDS_A_ROUND, ROUNDS = 32_000_000, 8
#: Words from which a text carries further parity bits, as words of 64.
WIDE, MORE = 250, 12
#: Classes that a task remembers, so that copies of a text are matched once a task.
REMEMBERED = 1 << 18

#: Rows of keys, and pairs of them, that a task looks at together.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 17

_SCAN = "id long, grp long, bag long, n int, cell int, df long"
_KEYS = "bag long, n int, bits binary, keys array<array<long>>"
_MET = "bag_a long, bag_b long, key long, bag long, n int, bits binary"


@dataclass
class NearDuplicates:
    """members: id, grp, bag, n; links: bag_a < bag_b, overlap. Both as tables."""

    members: DataFrame
    links: DataFrame


def _need(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _grouped_bags(batch: pa.RecordBatch):
    rows, tokens, bag, n = bags(batch.column("text"))
    with np.errstate(over="ignore"):
        grp = batch.column("grp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        bag = mix(bag + mix(grp + np.uint64(7)))
    return rows, tokens, bag, n, grp


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows than 14 bits can number."""
    for batch in batches:
        for at in range(0, len(batch), 8192):
            yield batch.slice(at, 8192)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each text that has words, then this task's counts of tokens by cell."""
    df = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        rows, tokens, bag, n, grp = _grouped_bags(batch)
        df += np.bincount((tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(df))
        has = np.flatnonzero(n > 0)
        none = pa.nulls(len(has), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(has)), pa.array(grp.view(np.int64)[has]), pa.array(bag.view(np.int64)[has]), pa.array(n[has].astype(np.int32)), none, none.cast(pa.int64())],
            names=["id", "grp", "bag", "n", "cell", "df"],
        )
    cells = np.flatnonzero(df)
    none = pa.nulls(len(cells), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, none.cast(pa.int32()), pa.array(cells.astype(np.int32)), pa.array(df[cells])],
        names=["id", "grp", "bag", "n", "cell", "df"],
    )


#: Sizes from which a class of sizes begins, each four times the one before.
SMALLEST, STEP = 24, 4


def size_class(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of a size and its number of groups, which grows with the prefix. Texts near a border take part in both classes."""
    c = np.where(n < SMALLEST, 0, np.floor(np.log(np.maximum(n, SMALLEST) / SMALLEST * (1 + 1e-12)) / np.log(STEP)).astype(np.int64) + 1)
    return c, groups_of(c)


def groups_of(c):
    return STEP**c


def match_keys(rows, tokens, n, grp, df, rank, threshold):
    """Arrays (key, row) of a batch."""
    cell = (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    place = rank[cell]
    # by row, then by count, then by token (of which 64 - 14 - CELL_BITS bits tell those of one cell apart)
    with np.errstate(over="ignore"):
        order = np.argsort((rows.astype(np.uint64) << np.uint64(50)) | (place.astype(np.uint64) << np.uint64(30)) | (tokens & np.uint64((1 << 30) - 1)))
    rows, tokens, place, d = rows[order], tokens[order], place[order], df[cell[order]]
    start = np.searchsorted(rows, np.arange(len(n)))
    pos = np.arange(len(rows)) - start[rows]
    base = n - _need(n, threshold) + 1
    rare = d <= RARE
    far = np.zeros(len(n), bool)
    far[rows[(pos < base[rows]) & ~rare]] = True
    # texts that can have a partner besides their equals: one as long or shorter, or a longer one
    able = (_need(n, threshold) < n) | (np.floor(n / threshold + 1e-9) > n)
    own, lo, hi = (size_class(m)[0] for m in (n, _need(n, threshold), np.floor(n / threshold + 1e-9).astype(np.int64)))
    longest = base + np.where(far, size_class(np.maximum(n, np.floor(n / threshold + 1e-9)))[1], 0)
    with np.errstate(over="ignore"):
        salt = mix(grp + np.uint64(3))
        single = np.flatnonzero(rare & (d > 1) & able[rows] & (pos < longest[rows]))
        keys, at = [mix(tokens[single] + salt[rows[single]])], [rows[single]]
        for c in np.unique(np.concatenate([own, lo, hi])) if len(n) else []:
            g = int(groups_of(c))
            here = far & able & ((own == c) | (lo == c) | (hi == c))
            t = np.flatnonzero(here[rows] & ~rare & (pos < (base + g)[rows]))
            group = rows[t] * g + place[t] % g
            by_group = np.argsort(group, kind="stable")
            t, group = t[by_group], group[by_group]
            step = 1
            while step < len(t) and (same := group[:-step] == group[step:]).any():
                a, b = t[:-step][same], t[step:][same]
                keys.append(mix(tokens[a] + mix(tokens[b] + np.uint64(c)) + salt[rows[a]]))
                at.append(rows[a])
                step += 1
    return np.concatenate(keys), np.concatenate(at)


def parity(rows: np.ndarray, tokens: np.ndarray, count: int, words: int = 4) -> np.ndarray:
    """Bits of each row as words of 64: bit = parity of the number of tokens that hash to it."""
    bits = words * 64
    bit = ((mix(tokens ^ np.uint64(0xA5A5 + words - 4)) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(rows * bits + bit, minlength=count * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, bits), axis=1, bitorder="little").view(np.int64)


def _parities(rows: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of each row, and the further ones of long texts behind them."""
    wide = n >= WIDE
    ends = np.cumsum(np.where(wide, 4 + MORE, 4))
    at = ends - np.where(wide, 4 + MORE, 4)
    flat = np.empty(ends[-1] if len(n) else 0, np.int64)
    flat[at[:, None] + np.arange(4)] = parity(rows, tokens, len(n))
    of_wide, some = np.cumsum(wide) - 1, wide[rows]
    flat[at[wide][:, None] + 4 + np.arange(MORE)] = parity(of_wide[rows[some]], tokens[some], int(wide.sum()), MORE)
    offsets = np.concatenate([[0], ends * 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _lists(key: np.ndarray, at: np.ndarray, count: int, rounds: int) -> pa.Array:
    """Keys of each of ``count`` rows, as a list of each round."""
    place = at * rounds + (key % np.uint64(rounds)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=count * rounds))
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key[order].view(np.int64)))
    return pa.ListArray.from_arrays(pa.array((np.arange(count + 1) * rounds).astype(np.int32)), inner)


def _keyed(df_cells, threshold: float, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = df_cells.value
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        seen: set[int] = set()
        for batch in _small(batches):
            rows, tokens, bag, n, grp = _grouped_bags(batch)
            # copies of a text have the same keys: once is enough
            first = np.unique(bag, return_index=True)[1]
            new = np.array([b not in seen for b in bag[first].tolist()], bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(bag[first[new]].tolist())
            keep = np.zeros(len(n), bool)
            keep[first[new]] = True
            of_kept = keep[rows]
            key, at = match_keys(rows[of_kept], tokens[of_kept], np.where(keep, n, 0), grp, df, rank, threshold)
            kept = pa.array(np.flatnonzero(keep))
            arrays = [pa.array(bag.view(np.int64)), pa.array(n.astype(np.int32)), _parities(rows, tokens, n), _lists(key, at, len(n), rounds)]
            yield pa.RecordBatch.from_arrays([x.take(kept) for x in arrays], names=["bag", "n", "bits", "keys"])

    return run


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, tokens, bag, n, _ = _grouped_bags(batch)
        has = pa.array(np.flatnonzero(n > 0))
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(has), pa.array(bag.view(np.int64)).take(has), arrays.take(has)], names=["id", "bag", "tokens"])


def _blocks(keys: DataFrame) -> DataFrame:
    """Rows of hot keys in blocks (lo, hi): those of two parts meet in one block, those of one part in that of the part."""
    parts = F.ceil(F.col("m") / HOT)
    own = keys.withColumn("part", F.pmod(F.col("bag"), parts))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))


def close_pairs(run: np.ndarray, n: np.ndarray, words: np.ndarray, at: np.ndarray, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one run that may share enough words by their sizes and parities.

    Rows come by run, then by size.  ``words`` holds the parities, those of row
    i from ``at[i]`` up to ``at[i + 1]``.  Rows of one side, unless it is
    negative, are no pair.
    """
    need = _need(n, threshold)
    spare = n - 2 * need
    first = np.ascontiguousarray(words[at[:-1, None] + np.arange(4)].T)
    wide = np.diff(at) > 4
    # partners as long or longer follow a row, up to where they are too long
    longest = np.minimum(np.floor((n + 1e-6) / threshold), 2**32 - 1).astype(np.int64)
    count = np.searchsorted(run << 32 | n, run << 32 | longest, side="right") - np.arange(len(n)) - 1
    ends = np.cumsum(count)
    lo = 0
    while lo < len(n):
        done = ends[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        c, own = count[lo:hi], np.arange(lo, hi)
        of = lambda x: np.repeat(x[lo:hi], c)
        i = np.repeat(own, c)
        j = np.arange(len(i)) + np.repeat(own + 1 - (ends[lo:hi] - c - done), c)
        # half of the bits end nearly all pairs
        apart = np.bitwise_count(of(first[0]) ^ first[0][j]) + np.bitwise_count(of(first[1]) ^ first[1][j])
        ok = np.flatnonzero(apart <= of(n) + spare[j])
        i, j, apart = i[ok], j[ok], apart[ok].astype(np.int64)
        apart += np.bitwise_count(first[2][i] ^ first[2][j])
        apart += np.bitwise_count(first[3][i] ^ first[3][j])
        ok = (apart <= n[i] + spare[j]) & (need[j] <= n[i])
        if side is not None:
            ok &= (side[i] < 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        both = np.flatnonzero(wide[i] & wide[j])
        ok = np.ones(len(i), bool)
        more = 4 + np.arange(MORE)
        apart = np.bitwise_count(words[at[i[both], None] + more] ^ words[at[j[both], None] + more]).sum(axis=1, dtype=np.int64)
        ok[both] = apart <= (n[i] + spare[j])[both]
        if ok.any():
            yield i[ok], j[ok]
        lo = hi


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of ``ROWS_AT_ONCE`` rows or more, but for the last."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += len(batch)
        if size >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if size:
        yield pa.Table.from_batches(some)


def _by_size(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by key, size and bag, each bag of a key once, and numbers of their keys."""
    key, bag, n = (rows.column(c).to_numpy() for c in ("key", "bag", "n"))
    run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    order = np.lexsort((bag, run << 32 | n))
    run, bag = run[order], bag[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (bag[1:] != bag[:-1])
    return rows.take(pa.array(order[new])), run[new]


def _pairs_of(rows: pa.Table, run: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    bag, n = rows.column("bag").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
    side = rows.column("side").to_numpy() if "side" in rows.column_names else None
    bits = pa.concat_arrays(rows.column("bits").cast(pa.large_binary()).chunks)
    _, offsets, data = bits.buffers()
    at = np.frombuffer(offsets, np.int64)[bits.offset : bits.offset + len(bits) + 1] >> 3
    words = np.frombuffer(data, np.uint64, count=int(at[-1]))
    for i, j in close_pairs(run, n, words, at, side, threshold):
        a, b = np.minimum(bag[i], bag[j]), np.maximum(bag[i], bag[j])
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=["bag_a", "bag_b", "key", "bag", "n", "bits"])


def _unmatched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    none = pa.nulls(len(rows), pa.int64())
    columns = [none, none, *(rows.column(c) for c in ("key", "bag", "n", "bits"))]
    yield from pa.table(columns, names=["bag_a", "bag_b", "key", "bag", "n", "bits"]).to_batches()


def _meeting(threshold: float, hot: int | None):
    """Pairs of rows that come sorted by key; rows of keys of more than ``hot`` rows pass unmatched."""

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, run = _by_size(rows)
        if hot is not None and len(run) and (many := np.bincount(run)[run] > hot).any():
            yield from _unmatched(rows.filter(pa.array(many)))
            rows, run = rows.filter(pa.array(~many)), run[~many]
        if len(run):
            yield from _pairs_of(rows, run, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for rows in _together(batches):
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows.column("key").to_numpy()
            if passing is not None and (past := int(np.searchsorted(key, passing, side="right"))):
                yield from _unmatched(rows.slice(0, past))
                rows, key = rows.slice(past), key[past:]
            held = None
            if len(key):
                # more rows of the last key may follow
                last = int(np.searchsorted(key, key[-1]))
                yield from met(rows.slice(0, last))
                held = rows.slice(last)
                if hot is not None and len(held) > hot and len(held := _by_size(held)[0]) > hot:
                    yield from _unmatched(held)
                    held, passing = None, key[-1]
        if held is not None:
            yield from met(held)

    return run


def _candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """bag_a < bag_b of rows of one key that may share enough words.

    Rows of hot keys come unmatched beside the pairs of the others; only if
    there are any they meet in blocks.
    """
    met = persist_table(keys.sortWithinPartitions("key").mapInArrow(_meeting(threshold, HOT), _MET).distinct())
    pairs, rest = met.where("key is null").select("bag_a", "bag_b"), met.where("key is not null").select("key", "bag", "n", "bits")
    pairs._path = met._path
    if rest.head(1):
        blocks = _blocks(rest.withColumn("m", F.count("*").over(Window.partitionBy("key"))))
        # rows of one part meet in their own block only
        side = F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("part") == F.col("hi")).cast("int")).alias("side")
        blocks = blocks.select(F.xxhash64("key", "lo", "hi").alias("key"), "bag", "n", "bits", side).repartition("key").sortWithinPartitions("key")
        more = blocks.mapInArrow(_meeting(threshold, None), _MET).select("bag_a", "bag_b")
        pairs = persist_table(pairs.unionByName(more).distinct())
        drop_table(met)
    return pairs


def _met(keyed: DataFrame, at: int, tasks: int, threshold: float) -> DataFrame:
    """Candidates of the keys of one round."""
    keys = keyed.select(F.explode(F.element_at("keys", at + 1)).alias("key"), "bag", "n", "bits")
    keys = keys.repartition(tasks, "key") if tasks > int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) else keys.repartition("key")
    return _candidates(keys, threshold)


def near_duplicates(texts: DataFrame, id_col: str, text: Column | str, group: Column | str | None = None, threshold: float = 0.85) -> NearDuplicates:
    """Classes of equal word multisets and the links between different classes.

    ``id_col`` is a long; rows with a null id are left out, repeated rows do no
    harm.  ``group`` (a long) restricts links and classes to rows of one group.
    Other columns of ``texts`` are not read.
    """
    with shuffles_released(texts.sparkSession):
        return _near_duplicates(texts, id_col, text, group, threshold)


def _near_duplicates(texts: DataFrame, id_col: str, text: Column | str, group: Column | str | None, threshold: float) -> NearDuplicates:
    spark = texts.sparkSession
    grp = F.lit(0) if group is None else (F.col(group) if isinstance(group, str) else group)
    col = F.col(text) if isinstance(text, str) else text
    source = texts.select(F.col(id_col).cast("long").alias("id"), grp.cast("long").alias("grp"), col.cast("string").alias("text")).where("id is not null and grp is not null and text is not null")

    scan = persist_table(source.mapInArrow(_scan, _SCAN))
    members = scan.where("bag is not null").select("id", "grp", "bag", "n").distinct()
    counts = scan.where("cell is not null").groupBy("cell").agg(F.sum("df").alias("df")).toArrow()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    cells[counts["cell"].to_numpy()] = counts["df"].to_numpy()
    # the text of each class that stands for it
    firsts = persist_table(members.groupBy("bag").agg(F.min("id").alias("id"), F.first("n").alias("n")))
    words, classes = firsts.agg(F.sum(F.col("n").cast("long")), F.count("*")).first()
    words = words or 0
    # copies of a text have the same keys; the few that pass meet as one
    matched = pruned(source, "id", firsts) if 2 * classes <= scan.where("bag is not null").count() else source
    rounds = min(ROUNDS, max(1, -(-words // WORDS_A_ROUND)))
    keyed = matched.select("id", "grp", "text").mapInArrow(_keyed(spark.sparkContext.broadcast(cells), threshold, rounds), _KEYS)
    if rounds > 1:
        keyed = persist_table(keyed)
    found = [_met(keyed, at, -(-words // (rounds * WORDS_A_TASK)), threshold) for at in range(rounds)]
    candidates = found[0]
    if rounds > 1:
        candidates = persist_table(reduce(DataFrame.unionByName, found).distinct())
        for table in (keyed, *found):
            drop_table(table)

    wanted = candidates.select(F.explode(F.array("bag_a", "bag_b")).alias("bag")).distinct()
    # one text of each class that may have a link
    ids = persist_table(firsts.select("bag", "id").join(wanted, "bag", "left_semi"))
    tokens = pruned(source, "id", ids).select("id", "grp", "text").mapInArrow(_tokens_of, "id long, bag long, tokens array<long>")
    tokens = persist_table(tokens.join(ids, ["bag", "id"], "left_semi").dropDuplicates(["bag"]).select("bag", "tokens"))
    ta, tb = tokens.select(F.col("bag").alias("bag_a"), F.col("tokens").alias("ta")), tokens.select(F.col("bag").alias("bag_b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    links = (
        candidates.join(ta, "bag_a")
        .join(tb, "bag_b")
        .select("bag_a", "bag_b", shared.alias("overlap"), F.greatest(F.size("ta"), F.size("tb")).alias("longer"))
        .where(F.col("overlap") >= F.ceil(F.col("longer") * threshold - 1e-9))
        .select("bag_a", "bag_b", "overlap")
    )
    return NearDuplicates(members, links)
