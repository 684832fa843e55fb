"""Values cut at a field limit or lost in transfer.

1. One pass over all values counts how often words, word pairs and word shapes
   occur and how often they end a sentence or line (count sketches of a fixed
   size), and the lengths of values that end without a closing mark by source,
   in characters and bytes.  Lengths far more frequent than those around them
   are the source's limits.
2. Intact values of a bounded sample are cut, at the limit of their source where
   they exceed it and anywhere else, and a hashed logistic regression learns
   to tell cut from intact by closing characters, how well the last words end
   something, open code blocks and quotes, and the length's relation to limits.
3. Every value is scored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table
from .words import mix

CELL_BITS = 20
WEIGHT_BITS = 18
#: Values the classifier is trained on.
SAMPLE = 24_000

_CLOSED = re.compile(r"[.!?…。؟]['\"”’»)\]*_`]*\s*$")
_DIGIT = re.compile(r"\d")
_RUNS = re.compile("0+")
_LETTERS = re.compile(r"[^\W\d_]+")
_STRIP = " \t\r\n.,;:!?…'\"“”‘’«»()[]{}*_`>"
_LIST = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s")
_LOG = re.compile(r"^\d{4}-\d\d-\d\dT|^\[?\d{4}-\d\d-\d\d[ T]")
_MARK = re.compile(r"[.!?](?=\s|$)")
_CAPITAL = re.compile(r"[.!?]\s+[A-ZÀ-Ý]")
_ALL64 = (1 << 64) - 1


def values(alpaca: DataFrame, chat: DataFrame) -> DataFrame:
    """sample_id, source, field, turn, value of every output and every message content that isn't null."""
    a = alpaca.select("sample_id", "source", F.lit("output").alias("field"), F.lit(-1).alias("turn"), F.col("output").alias("value"))
    c = chat.select("sample_id", "source", F.posexplode("messages").alias("turn", "m")).select("sample_id", "source", F.lit("messages.content").alias("field"), "turn", F.col("m.content").alias("value"))
    return a.unionByName(c).where("sample_id is not null and value is not null")


def core(word: str) -> str:
    return _DIGIT.sub("0", word.strip(_STRIP))


def shape(word: str) -> str:
    """Letters become a or A, digits 0; hosts, calls and the like keep their marks."""
    return _LETTERS.sub(lambda m: "A" if m[0][0].isupper() else "a", _DIGIT.sub("0", word.strip(_STRIP)))


def _cell(text: str, kind: str) -> int:
    return xxhash.xxh64_intdigest(kind + text) >> (64 - CELL_BITS)


def _end_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell, ends) of words, pairs and shapes: cells repeat as often as they occur. The last word of a value isn't counted."""
    marked = pc.replace_substring(texts, "\n", "\x01 ")
    parts = pc.ascii_split_whitespace(marked)
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    cores = [core(w.strip("\x01")).lower() for w in names]
    word = np.array([xxhash.xxh64_intdigest("w" + c) for c in cores], np.uint64)
    form = np.array([_cell(shape(w.strip("\x01")), "s") for w in names], np.int64)
    ends = np.array([w.endswith("\x01") or bool(_CLOSED.search(w)) for w in names])
    inner = np.ones(len(ids), bool)
    inner[offsets[1:][np.diff(offsets) > 0] - 1] = False
    first = np.zeros(len(ids), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    h, e = word[ids], ends[ids]
    with np.errstate(over="ignore"):
        pair = mix(np.concatenate([h[:1], h[:-1]]) * np.uint64(3) + h)
    top = np.uint64(64 - CELL_BITS)
    two = inner & ~first
    cells = np.concatenate([(h[inner] >> top).astype(np.int64), (pair[two] >> top).astype(np.int64), form[ids[inner]]])
    return cells, np.concatenate([e[inner], e[two], e[inner]])


def pair_cell(x: int, y: int) -> int:
    """Cell of two words by their hashes, as ``mix`` makes it of arrays."""
    x = x * 3 + y & _ALL64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL64
    return (x ^ x >> 31) >> (64 - CELL_BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, ends = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << CELL_BITS, np.int64)
    lengths: Counter[tuple] = Counter()
    seen = 0
    for b in batches:
        texts = b.column("value")
        cells, e = _end_counts(texts)
        total += np.bincount(cells, minlength=len(total))
        ends += np.bincount(cells[e], minlength=len(ends))
        seen += len(texts)
        for s, f, v in zip(b.column("source").to_pylist(), b.column("field").to_pylist(), texts.to_pylist(), strict=True):
            # a short value of few words is a name, number or the like: its length is no field's
            if (len(v) > 40 or v.count(" ") >= 3) and (v[-1].isalnum() or v[-1] in " ,;:-–—/(=_�"):
                lengths[s, f, "c", len(v)] += 1
                lengths[s, f, "b", len(v.encode())] += 1
    at = np.flatnonzero(total)
    n, m = len(at), len(lengths)
    keys = list(lengths)
    yield pa.RecordBatch.from_pydict(
        {
            "cell": pa.array([*at.tolist(), *[None] * m, None], pa.int32()),
            "total": pa.array([*total[at].tolist(), *lengths.values(), seen], pa.int64()),
            "ends": pa.array([*ends[at].tolist(), *[None] * (m + 1)], pa.int64()),
            "source": pa.array([*[None] * n, *(k[0] for k in keys), None], pa.string()),
            "field": pa.array([*[None] * n, *(k[1] for k in keys), None], pa.string()),
            "unit": pa.array([*[None] * n, *(k[2] for k in keys), None], pa.string()),
            "length": pa.array([*[None] * n, *(k[3] for k in keys), None], pa.int32()),
        }
    )


@dataclass
class TruncationModel:
    total: np.ndarray
    ends: np.ndarray
    #: (source, unit) -> limits found
    limits: dict[tuple[str | None, str], list[int]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << WEIGHT_BITS, np.float32))
    bias: float = 0.0
    slots: dict[str, int] = field(default_factory=dict, repr=False)
    paid: dict[str, float] = field(default_factory=dict, repr=False)
    words: dict[str, tuple] = field(default_factory=dict, repr=False)

    def state(self) -> dict:
        """What a worker needs to make the model."""
        return {k: getattr(self, k) for k in ("total", "ends", "limits", "weights", "bias")}

    def evidence(self, cell: int) -> tuple[int, int]:
        """(occurrences, how often they end something), both in steps of powers of two."""
        n, e = int(self.total[cell]), int(self.ends[cell])
        return min(n.bit_length(), 8), -1 if n == 0 else (0 if e == 0 else 1 + min(6, int(math.log2((e + 0.5) / (n + 1)) + 7)))

    def word(self, w: str) -> tuple:
        """(core in lower case, shape, evidence of both, hash of the core)."""
        found = self.words.get(w)
        if found is None:
            c, s = core(w).lower(), shape(w)
            h = xxhash.xxh64_intdigest("w" + c)
            found = (c, s, self.evidence(h >> (64 - CELL_BITS)), self.evidence(_cell(s, "s")), h)
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[w] = found
        return found

    def at_limit(self, source: str | None, chars: int, size: int) -> str:
        """Whether the length is a limit, and if not, its place among them."""
        c, b = self.limits.get((source, "c"), ()), self.limits.get((source, "b"), ())
        # a cut may fall inside a character or leave out blanks after it
        if any(0 <= x - chars <= 1 for x in c) or any(0 <= x - size <= 3 for x in b):
            return "at"
        if not c and not b:
            return "none"
        return "under" if all(chars < x for x in c) and all(size < x for x in b) else "over"

    def features(self, source: str | None, value: str) -> list[str]:
        chars = len(value)
        text = value.rstrip()
        if not text:
            return ["empty"]
        tail = text[-400:]
        words = tail[-200:].split()
        last = words[-1]
        before = words[-2] if len(words) > 1 else ""
        closed = bool(_CLOSED.search(tail[-12:]))
        fence = value.count("```")
        line = tail.rpartition("\n")[2]
        kind = "code" if fence % 2 else "fence" if tail.endswith("```") else "log" if _LOG.match(line) else "list" if _LIST.match(line) else "prose"
        marks = len(_MARK.findall(text[:-1]))
        first = next((ch for ch in text if ch.isalpha()), "A")
        loose = first.islower() and (marks == 0 or not _CAPITAL.search(text))
        size = "1" if chars < 24 and len(words) == 1 else "few" if len(words) < 5 else "many"
        limit = self.at_limit(source, chars, chars if value.isascii() else len(value.encode()))
        style = f"{kind}/{'closed' if closed else 'open'}/{'casual' if loose else 'formal'}"
        out = [f"style={style}", f"char={text[-1] if not text[-1].isalnum() else 'd' if text[-1].isdigit() else 'x'}/{kind}", f"limit={limit}/{closed}", f"size={size}/{closed}/{kind}", f"blank={value != text}/{closed}", f"marks={min(marks, 3)}/{style}"]
        if not closed:
            c, s, w, f, h = self.word(last)
            p = self.evidence(pair_cell(self.word(before)[4], h)) if before else (0, -1)
            out += [f"word={w}/{kind}", f"wordend={w[1]}/{style}/{size}", f"pair={p}/{kind}", f"pairend={p[1]}/{style}/{size}", f"form={f}/{kind}", f"shape={s}/{kind}/{size}", f"runs={_RUNS.sub('0', s)}/{kind}/{size}", f"last={c}", f"both={w}/{p}", f"end3={text[-3:]}", f"quote={(text.count('“') - text.count('”'))}/{text.count(chr(34)) % 2}/{text.count('(') - text.count(')')}"]
            if kind in ("log", "list"):
                # whether the last record ends as the nearest one before it does, by its last two words
                above = next((x.split() for x in reversed(tail[: -len(line) - 1].split("\n")) if (_LOG if kind == "log" else _LIST).match(x)), None)
                own = _RUNS.sub("0", s)
                near = _RUNS.sub("0", self.word(before)[1]) if len(line.split()) > 1 else ""
                if above:
                    same = _RUNS.sub("0", self.word(above[-1])[1]) == own
                    two = same and len(above) > 1 and _RUNS.sub("0", self.word(above[-2])[1]) == near
                    out.append(f"record={same}/{two}/{kind}")
                out.append(f"recordend={near}/{own}/{kind}")
            if kind == "list":
                # an item that appears as a whole elsewhere
                out.append(f"item={p}/{min(len(line.split()), 6)}")
        return out

    def indices(self, features: list[str]) -> list[int]:
        out = []
        for f in features:
            i = self.slots.get(f)
            if i is None:
                i = zlib.crc32(f.encode()) & ((1 << WEIGHT_BITS) - 1)
                if len(self.slots) > 300_000:
                    self.slots.clear()
                self.slots[f] = i
            out.append(i)
        return out

    def score(self, source: str | None, value: str | None) -> float:
        """Log odds that the value is cut; blank values are complete."""
        if value is None or not value.strip():
            return -30.0
        paid = self.paid
        if len(paid) > 300_000:
            paid.clear()
        odds = self.bias
        for f in self.features(source, value):
            v = paid.get(f)
            if v is None:
                v = paid[f] = float(self.weights[zlib.crc32(f.encode()) & ((1 << WEIGHT_BITS) - 1)])
            odds += v
        return odds


def find_limits(lengths: DataFrame) -> DataFrame:
    """source, unit, length of the limits among (source, unit, length, n): lengths of open values well above the 15 lengths on both sides.

    A source and unit have a row per length, so a window over them is bounded
    by the longest value, whatever the number of values.
    """
    around = Window.partitionBy("source", "unit").orderBy("length")
    beside = F.sum("n").over(around.rangeBetween(-15, 15)) - F.sum("n").over(around.rangeBetween(-2, 2))
    # short lengths have fewer below them
    places = F.lit(13) + F.least(F.lit(13), F.greatest(F.lit(0), F.col("length") - 3))
    return lengths.withColumn("beside", beside).where(F.col("n") >= 4 + 5 * F.col("beside") / places).select("source", "unit", "length")


def odd_record(value: str) -> bool:
    """Whether the last of several log records ends in a word of another shape than the one before it."""
    lines = [x for x in value[-2000:].split("\n") if x.strip()]
    logged = [x.split()[-1] for x in lines if _LOG.match(x)]
    return len(logged) > 1 and bool(_LOG.match(lines[-1])) and _RUNS.sub("0", shape(logged[-1])) != _RUNS.sub("0", shape(logged[-2]))


def casual(value: str, rng: random.Random) -> str | None:
    """A sentence of the value as people type it: no capital and no closing mark, but complete."""
    found = re.findall(r"(?:^|(?<=[.!?] ))[^\n.!?]{25,}(?=[.!?](?: |$))", value)
    if not found:
        return None
    text = rng.choice(found)
    return text.lower() if rng.random() < 0.5 else text[0].lower() + text[1:]


def bare_value(value: str, rng: random.Random) -> str | None:
    """An address, number or name of the value by itself or after one word: a complete short answer."""
    tokens = value.split()
    at = [i for i, t in enumerate(tokens[:-1]) if re.search(r"[\d/_]", t) and len(t) > 2 and t[0].isalnum()]
    if not at:
        return None
    i = rng.choice(at)
    found = tokens[i].strip(_STRIP)
    return f"{tokens[i - 1]} {found}" if i and rng.random() < 0.5 else found


def artificial_cuts(value: str, limits: list[int], sizes: list[int], rng: random.Random) -> list[str]:
    """The value cut at a limit it exceeds, in characters and bytes, and once elsewhere; cuts that leave a complete sentence or line are no cuts."""
    places = [x for x in limits if 4 < x < len(value)][:1]
    data = value.encode()
    places += [len(data[:x].decode(errors="ignore")) for x in sizes if 4 < x < len(data)][:1]
    if len(value) > 24:
        places.append(rng.randrange(16, len(value) - 1))
    out = []
    if places and rng.random() < 0.2:
        at = [i for i, ch in enumerate(value) if ord(ch) > 127 and i > 16]
        if at:
            # half a character is left
            out.append(value[: rng.choice(at)] + "\ufffd")
    for x in places:
        head, rest = value[:x], value[x:]
        if not rest.strip(_STRIP) or (_CLOSED.search(head[-12:]) and (rest[0].isspace() or head[-1].isspace())):
            continue
        # half a number looks whole, so it teaches nothing
        if head[-1].isdigit() and rest[0].isdigit():
            continue
        if head.count("```") % 2 == 0 and ("\n" == rest[0] or head.rstrip(" ").endswith("\n")):
            continue
        out.append(head)
    return out


def logistic(rows: list[list[int]], y: np.ndarray, epochs: int = 12, rate: float = 0.3, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Hashed logistic regression by Adagrad on mini-batches."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    w, g2 = np.zeros(1 << WEIGHT_BITS), np.full(1 << WEIGHT_BITS, 1e-6)
    b = 0.0
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 128)):
            idx = np.concatenate([flat[start[i] : start[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), size[part])
            z = np.bincount(own, weights=w[idx], minlength=len(part)) + b
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            u, inv = np.unique(idx, return_inverse=True)
            g = np.bincount(inv, weights=d[own], minlength=len(u)) / len(part) + l2 * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            b -= 0.05 * d.mean()
    return w.astype(np.float32), float(b)


def fit_truncation(cells: DataFrame, seed: int = 3, sample: int = SAMPLE) -> TruncationModel:
    """Fit on values(...); about ``sample`` values are used for training, all of them for counts and limits."""
    spark = cells.sparkSession
    base = cells.select("sample_id", "source", "field", "turn", F.col("value").cast("string").alias("value"))
    counted = persist_table(base.select("source", "field", "value").mapInArrow(_count, "cell int, total long, ends long, source string, field string, unit string, length int"))
    table = counted.where("cell is not null").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")).toArrow()
    total, ends = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << CELL_BITS, np.int64)
    at = table["cell"].to_numpy()
    total[at], ends[at] = table["total"].to_numpy(), table["ends"].to_numpy()
    spikes = find_limits(counted.where("length is not null").groupBy("source", "unit", "length").agg(F.sum("total").alias("n")))
    limits: dict[tuple[str | None, str], list[int]] = {}
    for r in spikes.orderBy("length").collect():  # a few of each source
        limits.setdefault((r["source"], r["unit"]), []).append(r["length"])
    model = TruncationModel(total, ends, limits)
    seen = counted.where("cell is null and length is null").agg(F.sum("total")).first()[0] or 0
    parts = 1 << 20
    keep = min(parts, int(parts * sample / max(1, seen)) + 1)
    # the share bounds the sample, in every task by itself
    drawn = base.where(F.pmod(F.xxhash64(F.lit(seed), "sample_id", "turn"), F.lit(parts)) < keep).repartition(spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(model.state())

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = TruncationModel(**shared.value)
        for b in batches:
            x, y = [], []
            for s, i, t, v in zip(b["source"], b["sample_id"], b["turn"], b["value"], strict=True):
                s = None if pd.isna(s) else s
                # not intact: at a limit without a closing mark, an open code block, or a log record unlike the one before
                if not v.strip() or v.count("```") % 2 or odd_record(v) or m.at_limit(s, len(v), len(v.encode())) == "at" and not _CLOSED.search(v[-12:]):
                    continue
                rng = random.Random(f"{i}/{t}")
                x.append(m.indices(m.features(s, v)))
                y.append(0)
                heads = artificial_cuts(v, m.limits.get((s, "c"), []), m.limits.get((s, "b"), []), rng)
                if rng.random() < 0.3 and (loose := casual(v, rng)):
                    x.append(m.indices(m.features(s, loose)))
                    y.append(0)
                    if rng.random() < 0.3:
                        heads += artificial_cuts(loose, [], [], rng)
                if rng.random() < 0.15 and (bare := bare_value(v, rng)):
                    x.append(m.indices(m.features(s, bare)))
                    y.append(0)
                for head in heads:
                    x.append(m.indices(m.features(s, head)))
                    y.append(1)
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "y": pd.Series(y, dtype="int32")})

    got = drawn.mapInPandas(examples, "x array<int>, y int").toPandas()
    y = got["y"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        x = [list(r) for r in got["x"]]
        weights, bias = logistic(x, y, epochs=6)
        # "intact" values that look cut are cut ones of the data: leave them out
        z = np.array([weights[r].sum() + bias for r in x])
        clean = np.flatnonzero((y == 1) | (z < 0.5))
        model.weights, model.bias = logistic([x[i] for i in clean], y[clean])
    model.slots.clear(), model.words.clear(), model.paid.clear()
    return model


def score_values(cells: DataFrame, model: TruncationModel, cutoff: float = 0.5) -> DataFrame:
    """sample_id, source, field, turn, truncated, odds of every value. Null and blank values are complete; rows are kept as often as they come."""
    shared = cells.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = TruncationModel(**shared.value)
        for b in batches:
            odds = np.array([m.score(None if pd.isna(s) else s, v) for s, v in zip(b["source"], b["value"], strict=True)], float)
            yield b[["sample_id", "source", "field", "turn"]].assign(truncated=odds > cutoff, odds=odds)

    return cells.select("sample_id", "source", "field", "turn", "value").mapInPandas(run, "sample_id long, source string, field string, turn int, truncated boolean, odds double")


def truncation_rates(scored: DataFrame) -> DataFrame:
    """source, field, n_values, n_truncated, rate; a value delivered repeatedly counts once."""
    one = scored.groupBy("sample_id", "field", "turn").agg(F.max(F.struct("source", "truncated")).alias("r"))
    return one.groupBy(F.col("r.source").alias("source"), "field").agg(F.count("*").alias("n_values"), F.count_if("r.truncated").alias("n_truncated")).withColumn("rate", F.col("n_truncated") / F.col("n_values"))
