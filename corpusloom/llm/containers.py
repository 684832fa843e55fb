"""Filling fixed-capacity windows with items: a grouping genetic algorithm on islands.

The items of a run are spread by hash over blocks of about ``BLOCK`` items, so
a run of any size is packed by many tasks.  Every block is evolved on several
islands; between rounds each island gets the elite of its neighbour.  A
crossover injects the best filled windows of one parent into the other, drops
the windows that hold the same items twice and puts displaced items back: first
in exchange for smaller ones, then by best fit.  A block ends where a lower
bound says that no packing has fewer windows.  Windows that stay badly filled
are opened again and their items packed once more across the blocks of the run;
a run keeps its first packing unless the second one has fewer windows.

Items longer than a window are cut into full windows and a rest; no other item
is ever divided.
"""

from __future__ import annotations

import random
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table

BLOCK = 2000
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 30
#: Generations without a window less after which an island rests.
PATIENCE = 10
POPULATION = 5
#: Windows of a block filled less than this are opened for the second level.
OPEN = 0.98

@dataclass
class Packing:
    """Items of each window, and how full each is."""

    bins: list[list[int]]
    fill: list[int]

    def score(self) -> tuple[int, int]:
        """Fewer windows first, then the sum of squared fillings: full and empty windows beat even ones."""
        return -len(self.bins), sum(f * f for f in self.fill)


def best_fit(order: list[int], sizes: list[int], cap: int, into: Packing) -> None:
    """Put items, in this order, each into the window with the least room that takes it."""
    bins, fill = into.bins, into.fill
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        by_room.setdefault(cap - f, []).append(b)
        mask |= 1 << (cap - f)
    for i in order:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
            fill[b] += s
        else:
            b = len(bins)
            bins.append([i])
            fill.append(s)
        r = cap - fill[b]
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r


def packed(order: list[int], sizes: list[int], cap: int) -> Packing:
    out = Packing([], [])
    best_fit(order, sizes, cap, out)
    return out


def least_windows(sizes: list[int], cap: int) -> int:
    """Windows that no packing can do without.

    For every size k up to half a window: items over cap - k stand alone,
    those over half a window can't meet each other, and what items from k on
    need beyond the room beside these takes more windows.
    """
    if not sizes:
        return 0
    s = np.sort(np.asarray(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(s)])
    k = np.unique(np.concatenate([[0], s[2 * s <= cap]]))
    half = int(np.searchsorted(s, cap // 2, "right"))
    alone = np.searchsorted(s, cap - k, "right")
    begin = np.searchsorted(s, k, "left")
    large, wide = len(s) - alone, np.maximum(0, alone - half)
    room = wide * cap - (upto[alone] - upto[np.minimum(half, alone)])
    rest = upto[np.minimum(half, alone)] - upto[np.minimum(begin, half)]
    return int((large + wide + np.maximum(0, -(-(rest - room) // cap))).max())


def refill(kept: Packing, displaced: list[int], sizes: list[int], cap: int) -> Packing:
    """Put displaced items back: first in place of smaller ones that make room for them, then by best fit."""
    free = sorted((sizes[i], i) for i in displaced)
    for b, items in enumerate(kept.bins):
        room = cap - kept.fill[b]
        if not room or not free:
            continue
        # the exchange that fills the window most
        gain, out, at = 0, -1, -1
        for x, i in enumerate(items):
            j = bisect_right(free, (sizes[i] + room, len(sizes))) - 1
            if j >= 0 and free[j][0] - sizes[i] > gain:
                gain, out, at = free[j][0] - sizes[i], x, j
        if gain:
            i = items[out]
            items[out] = free.pop(at)[1]
            kept.fill[b] += gain
            insort(free, (sizes[i], i))
    best_fit([i for _, i in reversed(free)], sizes, cap, kept)
    return kept


def crossover(a: Packing, b: Packing, sizes: list[int], cap: int, rng: random.Random) -> Packing:
    """Whole well-filled windows of b beside those windows of a that share no item with them, but for the worst ones and a few others."""
    best = sorted(range(len(b.bins)), key=b.fill.__getitem__, reverse=True)[: max(1, len(b.bins) // 3)]
    injected = rng.sample(best, max(1, len(best) // 2))
    inside = {i for j in injected for i in b.bins[j]}
    opened = {min(range(len(a.bins)), key=a.fill.__getitem__), *rng.sample(range(len(a.bins)), min(len(a.bins), 3))}
    child, displaced = Packing([list(b.bins[j]) for j in injected], [b.fill[j] for j in injected]), []
    for j, items in enumerate(a.bins):
        if j not in opened and inside.isdisjoint(items):
            child.bins.append(list(items))
            child.fill.append(a.fill[j])
        else:
            displaced += [i for i in items if i not in inside]
    return refill(child, displaced, sizes, cap)


def evolve(sizes: list[int], cap: int, seed: int, elites: list[Packing], generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing an island finds, never worse than best fit by falling size or the elites it got.

    Ends where no packing can have fewer windows, or no window less was found for ``PATIENCE`` generations.
    """
    if not sizes:
        return Packing([], [])
    rng = random.Random(seed)
    least = least_windows(sizes, cap)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    pool = [packed(order, sizes, cap), *elites]
    scored = sorted(((p.score(), p) for p in pool), key=lambda x: x[0], reverse=True)
    if len(scored[0][1].bins) <= least:
        return scored[0][1]
    while len(scored) < population:
        noise = [s * rng.uniform(0.8, 1.0) for s in sizes]
        p = packed(sorted(order, key=noise.__getitem__, reverse=True), sizes, cap)
        scored.append((p.score(), p))
    scored.sort(key=lambda x: x[0], reverse=True)
    fewest, since = len(scored[0][1].bins), 0
    for _ in range(generations):
        i, j = rng.sample(range(min(4, len(scored))), 2)
        child = crossover(scored[i][1], scored[j][1], sizes, cap, rng)
        scored = sorted([*scored, (child.score(), child)], key=lambda x: x[0], reverse=True)[:population]
        since = since + 1 if len(scored[0][1].bins) == fewest else 0
        fewest = len(scored[0][1].bins)
        if fewest <= least or since >= PATIENCE:
            break
    return scored[0][1]


def _labels(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(packing.bins):
        for i in items:
            out[i] = b
    return out


def _packing(labels, sizes: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(labels.tolist()):
        bins.setdefault(b, []).append(i)
    return Packing(list(bins.values()), [sum(sizes[i] for i in x) for x in bins.values()])


_ISLAND = "grp string, block int, island int, cap int, ids array<string>, sizes array<int>, elite array<int>, score double"


def _round(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            elite, score = [], []
            for row in batch.itertuples(index=False):
                sizes, cap = row.sizes.tolist(), int(row.cap)
                elites = [_packing(e, sizes) for e in (row.elite, row.guest) if e is not None]
                best = evolve(sizes, cap, hash((row.block, row.island, number)), elites)
                elite.append(_labels(best, len(sizes)))
                windows, square = best.score()
                score.append(windows + square / cap**2 / (1 + len(best.bins)))
            yield batch.drop(columns=["guest"]).assign(elite=elite, score=score)

    return run


def _pack_level(items: DataFrame) -> DataFrame:
    """items: grp, id, size, cap. Adds block and bin; window = (grp, block, bin)."""
    count = items.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = items.join(count, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a block is bounded by its making: BLOCK items on average, by hash
    blocks = spread.groupBy("grp", "block").agg(F.first("cap").alias("cap"), F.sort_array(F.collect_list(F.struct("id", "size"))).alias("x")).select("grp", "block", "cap", F.col("x.id").alias("ids"), F.col("x.size").alias("sizes"))
    state = blocks.select("grp", "block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "cap", "ids", "sizes", F.lit(None).cast("array<int>").alias("elite"), F.lit(0.0).alias("score"), F.lit(None).cast("array<int>").alias("guest"))
    for r in range(ROUNDS):
        # as many tasks as blocks and islands ask for
        done = persist_table(state.repartition(F.col("grp"), F.col("block"), F.col("island")).mapInPandas(_round(r), _ISLAND))
        guest = done.select("grp", "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        state = done.join(guest, ["grp", "block", "island"])
    best = done.groupBy("grp", "block").agg(F.max_by(F.struct("ids", "sizes", "elite", "cap"), F.struct("score", "island")).alias("b"))
    return best.select("grp", "block", F.col("b.cap").alias("cap"), F.explode(F.arrays_zip("b.ids", "b.sizes", "b.elite")).alias("i")).select("grp", "block", "cap", F.col("i.ids").alias("id"), F.col("i.sizes").alias("size"), F.col("i.elite").alias("bin"))


def pack(items: DataFrame) -> DataFrame:
    """Windows for items (grp string, id string, size int, cap int): grp, id, size, cap, window string.

    All items of a grp have one cap.  Sizes are from 1 to cap.
    """
    first = persist_table(_pack_level(items))
    place = ["grp", "block", "bin"]
    filled = first.groupBy(*place).agg((F.sum("size") / F.max("cap")).alias("fill"))
    marked = first.join(filled.where(F.col("fill") < OPEN).select(*place, F.lit(True).alias("open")), place, "left")
    named = lambda level: F.concat_ws("-", F.lit(level), "block", "bin").alias("window")
    again = persist_table(_pack_level(marked.where("open").select("grp", "id", "size", "cap")).select("grp", "id", "size", "cap", named("b")))
    # whether the second packing of a run is the better one
    before = filled.where(F.col("fill") < OPEN).groupBy("grp").agg(F.count("*").alias("before"))
    after = again.groupBy("grp").agg(F.count_distinct("window").alias("after"))
    better = before.join(after, "grp").where("after < before").select("grp", F.lit(True).alias("better"))
    kept = marked.join(better, "grp", "left").where("open is null or better is null").select("grp", "id", "size", "cap", named("a"))
    return kept.unionByName(again.join(better, "grp", "left_semi"))


def valid_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """report_id, run_id, n_tokens, cap: one per report_id with a positive n_tokens and a run of a positive max_seq_len.

    Of rows with one report_id the first received valid one counts (ties: the
    smallest run_id and n_tokens).
    """
    one = reports.where("report_id is not null and run_id is not null and n_tokens > 0").groupBy("report_id").agg(F.min(F.struct("received_at", "run_id", "n_tokens")).alias("r")).select("report_id", "r.run_id", "r.n_tokens")
    caps = runs.where("run_id is not null and max_seq_len > 0").groupBy("run_id").agg(F.max("max_seq_len").alias("cap"))
    return one.join(caps, "run_id")


def fill_windows(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, report_id, piece, start, n_tokens, window, max_seq_len: where every piece of every valid report lies.

    ``start`` is the first token of the piece in its report.  Null, zero and
    negative n_tokens, null ids and unknown runs are left out; empty tables
    give no rows; other columns are not read.
    """
    base = valid_reports(reports, runs)
    # full windows need no packing
    full = F.floor(F.col("n_tokens") / F.col("cap")).cast("int")
    pieces = base.where(F.col("n_tokens") >= F.col("cap")).select("run_id", "report_id", "cap", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    pieces = pieces.select("run_id", "report_id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "report_id", "piece").alias("window"), F.col("cap").alias("max_seq_len"))
    rest = base.withColumn("full", full).withColumn("size", (F.col("n_tokens") - F.col("full") * F.col("cap")).cast("int")).where("size > 0")
    packed_rest = pack(rest.select(F.col("run_id").alias("grp"), F.concat_ws(":", "report_id", "full").alias("id"), "size", F.col("cap").cast("int").alias("cap")))
    part = F.split("id", ":")
    placed = packed_rest.select(F.col("grp").alias("run_id"), part[0].cast("long").alias("report_id"), part[1].cast("int").alias("piece"), (part[1].cast("int") * F.col("cap")).alias("start"), F.col("size").alias("n_tokens"), "window", F.col("cap").alias("max_seq_len"))
    return pieces.unionByName(placed)


def filling(windows: DataFrame) -> DataFrame:
    """By run: reports, windows, tokens, the least number of windows any packing needs, and the share of the windows filled."""
    return windows.groupBy("run_id").agg(F.max("max_seq_len").alias("max_seq_len"), F.count_distinct("report_id").alias("n_reports"), F.count_distinct("window").alias("n_windows"), F.sum("n_tokens").alias("n_tokens")).select("*", F.ceil(F.col("n_tokens") / F.col("max_seq_len")).alias("least_windows"), (F.col("n_tokens") / (F.col("n_windows") * F.col("max_seq_len"))).alias("filled"))
