"""Training-data operators against brute force, round trips and held-out cases, with their edge cases."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import containers, defects, encoding, groups, language, leakage, mixing, neardup, overlap, pruning, queries, truncation, words

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def bag(text):
    pieces = ("".join(c for c in p if c.isalnum()) for p in re.split(r"[ \t\r\n\v\f]+", (text or "").lower()))
    return Counter(p for p in pieces if p)


def near(a, b, t=0.85):
    n = max(sum(a.values()), sum(b.values()))
    return n > 0 and sum((a & b).values()) >= t * n - 1e-9


# --- words and near-duplicates -------------------------------------------------


def test_words_and_bags():
    import pyarrow as pa

    texts = ["A b, a!", "", None, "  \n", "Ümlaut ümlaut x-y", "?!"]
    rows, tokens, h, n = words.bags(pa.array(texts, pa.string()))
    assert n.tolist() == [sum(bag(t).values()) for t in texts]
    other = words.bags(pa.array(["a a B"], pa.string()))
    assert other[2][0] == h[0] and h[1] == h[2] == h[3] == 0


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[at] = rng.choice(WORDS)
        elif kind < 0.7:
            w.insert(at, rng.choice(WORDS))
        elif len(w) > 1:
            del w[at]
    if rng.random() < 0.5:
        rng.shuffle(w)
    return " ".join(w)


def corpus(seed, n=160):
    """Texts of all sizes from few words, so that prefixes are costly and sizes lie around the class borders."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size = rng.choice([1, 2, 5, 6, 7, 8, 15, 22, 24, 26, 60, 120, 250, 258, 300])
        text = " ".join(rng.choice(WORDS[: rng.choice([12, 60, 400])]) for _ in range(size))
        out.append(text)
        for _ in range(rng.choice([0, 1, 2])):
            out.append(edited(rng, text, max(1, int(size * rng.choice([0.02, 0.08, 0.14, 0.2])))))
    return out + out[:15] + ["", "   ", None, "x " * 4000]


@pytest.mark.parametrize("seed, rare, hot", [(1, 100, 20_000), (2, 2, 20_000), (3, 1, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, rare, hot):
    """With few rare tokens nearly all keys are pairs; with a low limit hot keys are split into blocks, and tasks forget the texts they saw."""
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr(neardup, "REMEMBERED", 5)
        monkeypatch.setattr(neardup, "WORDS_A_TASK", 100)
    texts = corpus(seed)
    rows = [(i, i % 2, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:20] + [(None, 0, "a b c d e f g", 7)], "id long, part long, text string, bag int")
    found = neardup.near_duplicates(df, "id", "text", group="part")
    member = {r["id"]: r["bag"] for r in found.members.collect()}
    linked = {(r["bag_a"], r["bag_b"]) for r in found.links.collect()}
    bags = {i: bag(t) for i, t in enumerate(texts) if bag(t)}
    assert set(member) == set(bags)
    for i in bags:
        for j in bags:
            if i < j:
                got = member[i] == member[j] or (min(member[i], member[j]), max(member[i], member[j])) in linked
                assert got == (i % 2 == j % 2 and near(bags[i], bags[j])), (texts[i], texts[j])


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.8, 0.85])
def test_near_duplicates_of_few_words(spark, threshold):
    """Texts of one to seven words, whatever the threshold."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(WORDS[:9]) for _ in range(rng.randrange(1, 8))) for _ in range(120)] + ["a b c d e", "a b c d f", "a b c d"]
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", F.col("text"), threshold=threshold)
    bag_of = {r["id"]: r["bag"] for r in found.members.collect()}
    links = {frozenset((r["bag_a"], r["bag_b"])) for r in found.links.collect()}
    bags = [bag(t) for t in texts]
    assert links == {frozenset((bag_of[i], bag_of[j])) for i in range(len(texts)) for j in range(i) if bag_of[i] != bag_of[j] and near(bags[i], bags[j], threshold)}


def test_one_template_in_many_texts(spark, monkeypatch):
    """100,000 texts of one template with other values: the rows of its keys are spread over blocks of like size."""
    monkeypatch.setattr(neardup, "HOT", 5_000)
    template = " ".join(f"t{i}" for i in range(40))
    value = lambda c: F.concat(F.lit(c), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(40)).cast("string"))
    values = [value(c) for c in "abcdefghij"]
    df = spark.range(100_000).select("id", F.concat_ws(" ", F.lit(template), *values).alias("text"))
    keys = df.select(F.lit(1).cast("long").alias("key"), F.xxhash64("text").alias("bag"), F.lit(100_000).cast("long").alias("m"))
    blocks = neardup._blocks(keys).groupBy("lo", "hi").count().collect()
    assert len(blocks) == 20 * 21 // 2 and max(r["count"] for r in blocks) < 2.3 * neardup.HOT
    # a few thousand of them end to end: no text has a partner by chance, but every text has its edited copy
    some = df.where("id < 3000").unionByName(df.where("id < 3000").select((F.col("id") + 1_000_000).alias("id"), F.concat("text", F.lit(" more")).alias("text")))
    monkeypatch.setattr(neardup, "HOT", 500)
    found = neardup.near_duplicates(some, "id", "text", threshold=0.97)
    degree = found.links.select(F.explode(F.array("bag_a", "bag_b")).alias("bag")).distinct().count()
    assert degree == found.members.select("bag").distinct().count()


def test_long_texts_end_inside_the_join(spark, monkeypatch):
    """Unrelated texts of 450 common words are no candidates, edited ones are, in several rounds, and copies are matched once."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(450)) for _ in range(40)]
    texts += [edited(rng, t, 20) for t in texts[:5]]
    monkeypatch.setattr(neardup, "WORDS_A_ROUND", 5_000)
    met, former = [], neardup._met
    monkeypatch.setattr(neardup, "_met", lambda *a: met.append(former(*a)) or met[-1])
    monkeypatch.setattr(neardup, "drop_table", lambda df: None)
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts * 3)), "id long, text string"), "id", "text")
    bag_of = {r["id"]: r["bag"] for r in found.members.collect()}
    links = {frozenset((r["bag_a"], r["bag_b"])) for r in found.links.collect()}
    assert links == {frozenset((bag_of[i], bag_of[40 + i])) for i in range(5)}
    assert len(met) == 5 and {frozenset(r) for m in met for r in m.collect()} == links
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("seed, hot, at_once", [(1, None, 7), (2, 6, 7), (3, 6, 1 << 17), (4, 1, 3)])
def test_rows_of_a_key_meet_once(monkeypatch, seed, hot, at_once):
    """Pairs of close rows of each key, whatever the batches it comes in; rows of hot keys pass unmatched, copies of a row don't make a key hot."""
    monkeypatch.setattr(neardup, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 7, 40, 246, 250, 290]))) for _ in range(12)]
    texts += [edited(rng, t, max(1, len(t.split()) // rng.choice([8, 12, 40]))) for t in texts for _ in range(2)]
    tokens_at, tokens, bag_hash, n = words.bags(pa.array(texts))
    bags_of, bits = bag_hash.view(np.int64).tolist(), neardup._parities(tokens_at, tokens, n).to_pylist()
    rows = [(key, rng.randrange(len(texts))) for key in range(-20, 20) for _ in range(rng.choice([1, 2, 5, 9, 30]))]
    rows += [(99, 0)] * 25
    table = pa.table({"key": pa.array([k for k, _ in rows]), "bag": pa.array([bags_of[t] for _, t in rows]), "n": pa.array([int(n[t]) for _, t in rows], pa.int32()), "bits": pa.array([bits[t] for _, t in rows])})
    met = [r for b in neardup._meeting(0.85, hot)(iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist()]

    def close(a, b):
        x, y = (np.frombuffer(bits[t], np.uint64) for t in (a, b))
        longer = max(int(n[a]), int(n[b]))
        need = int(np.ceil(0.85 * longer - 1e-9))
        room = int(n[a]) + int(n[b]) - 2 * need
        apart = np.bitwise_count(x[: len(y)] ^ y[: len(x)]).astype(int)
        return min(n[a], n[b]) >= need and apart[:4].sum() <= room and apart[4:].sum() <= room

    of_key = {k: {t for q, t in rows if q == k} for k, _ in rows}
    of_key = {k: {min(t for t in ts if bags_of[t] == b) for b in {bags_of[t] for t in ts}} for k, ts in of_key.items()}
    many = {k for k, ts in of_key.items() if hot is not None and len(ts) > hot}
    assert 99 not in many and (hot is None or many)
    want = sorted(tuple(sorted((bags_of[a], bags_of[b]))) for k, ts in of_key.items() if k not in many for a in ts for b in ts if a < b and close(a, b))
    # each pair once a key
    assert sorted((r["bag_a"], r["bag_b"]) for r in met if r["key"] is None) == want
    assert bool(want) == (hot != 1)
    assert {(r["key"], r["bag"], r["n"], r["bits"]) for r in met if r["key"] is not None} == {(k, bags_of[t], int(n[t]), bits[t]) for k in many for t in of_key[k]}


def test_keys_are_sorted_once_and_not_joined(spark, monkeypatch):
    """Rows of keys with their parities go through one exchange and one sort; no join looks at every pair in both orders."""
    plans, former = [], neardup.persist_table
    monkeypatch.setattr(neardup, "persist_table", lambda df: plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or former(df))
    texts = corpus(6)[:60]
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    assert found.links.count()
    plan = next(p for columns, p in plans if columns[:2] == ["bag_a", "bag_b"])
    assert "Join" not in plan and "Window" not in plan and plan.count("Sort ") == 1


def test_pruned(spark, monkeypatch):
    rows = spark.range(20_000).select("id", F.lit(1).alias("_x")).unionByName(spark.createDataFrame([(None, 1)], "id long, _x int"))
    wanted = spark.range(0, 20_000, 50)
    got = {r["id"] for r in pruning.pruned(rows, "id", wanted).collect()}
    assert {r["id"] for r in wanted.collect()} <= got and len(got) < 2_500 and None not in got
    assert pruning.pruned(rows, "id", wanted.limit(0)).count() == 0
    assert pruning.pruned(rows, "id", wanted, most=10).count() == 20_001
    assert [pruning.bits_for(n) for n in (0, 5_000, 1 << 20, 1 << 23)] == [1 << 16, 1 << 17, 1 << 24, 1 << 26]


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert found.members.count() == 0 and found.links.count() == 0


def test_connected(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in groups.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_p3_found_equals_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    got = {tuple(r) for r in queries.p3_found(spark, sf).collect()}
    rows = {r["sample_id"]: r["messages"] for r in spark.read.parquet(f"{sf}/chat_samples.parquet").collect()}
    bags = {i: b for i, m in rows.items() if m and (b := bag(" ".join(x["content"] or "" for x in m)))}
    ids = sorted(bags)
    assert got == {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(bags[a], bags[b])}


def test_p3_groups(spark):
    rows = queries.p3_groups(spark, SF).collect()
    assert len(rows) == len({r["sample_id"] for r in rows})


def test_p4_found_equals_brute_force(spark):
    got = {tuple(r) for r in queries.p4_found(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    at = {(r["shard_no"], r["doc_index"]): (r["doc_id"], bag(r["text"])) for r in docs}
    expected = set()
    for b in spark.read.parquet(f"{SF}/split_meta.parquet").collect():
        sides = [[at[b["shard_no"], i] for i in set(b[c]) if (b["shard_no"], i) in at] for c in ("train_doc_indices", "val_doc_indices")]
        expected |= {(b["build_id"], min(t[0], v[0]), max(t[0], v[0])) for t in sides[0] for v in sides[1] if near(t[1], v[1])}
    assert got == expected


def test_overlap_edges(spark):
    docs = spark.createDataFrame([(1, 0, 0, "", "s"), (2, 0, 1, "a b c", None), (3, 0, 2, "C b, a", "s"), (4, 1, 0, "a b c", "s")], "doc_id long, shard_no int, doc_index long, text string, source string")
    schema = "build_id long, shard_no int, train_doc_indices array<long>, val_doc_indices array<long>"
    builds = spark.createDataFrame([(1, 0, [0, 1, 1, 99], [0, 2, None]), (1, 0, [0, 1, 1, 99], [0, 2, None]), (2, 1, None, [0])], schema)
    found = overlap.split_overlaps(docs, builds)
    assert sorted((r["build_id"], r["train_doc"], r["val_doc"], r["kind"]) for r in found.pairs().collect()) == [(1, 1, 1, "same"), (1, 2, 3, "equal")]
    assert found.report().count() == 4
    none = overlap.split_overlaps(docs, spark.createDataFrame([], schema))
    assert none.pairs().count() == 0 and none.documents().count() == 0 and none.report().count() == 0


def test_overlap_counts_are_those_of_the_pairs(spark):
    """The report made of counts by class, and the counterparts by document, equal what the expanded pairs give."""
    rng = random.Random(18)
    texts = [" ".join(rng.choice(WORDS[:40]) for _ in range(12)) for _ in range(8)]
    docs = [(i, i % 2, i // 2, edited(rng, rng.choice(texts), rng.choice([0, 0, 1, 2])), rng.choice(["s", "t", None])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, shard_no int, doc_index long, text string, source string")
    builds = [(b, b % 2, [rng.randrange(60) for _ in range(40)], [rng.randrange(60) for _ in range(20)]) for b in range(4)]
    found = overlap.split_overlaps(df, spark.createDataFrame(builds, "build_id long, shard_no int, train_doc_indices array<long>, val_doc_indices array<long>"))
    expected, partners = {}, Counter()
    for r in found.pairs().collect():
        for side in ("train", "val"):
            expected.setdefault((r["build_id"], side, r[f"{side}_source"], r["kind"]), []).append(r[f"{side}_doc"])
            partners[r["build_id"], side, r[f"{side}_doc"], r["kind"]] += 1
    assert {k[3] for k in expected} == {"same", "equal", "near"}
    assert {(r["build_id"], r["side"], r["source"], r["kind"]): (r["n_documents"], r["n_pairs"]) for r in found.report().collect()} == {k: (len(set(v)), len(v)) for k, v in expected.items()}
    rows = found.documents().collect()
    assert len(rows) == len({(r["build_id"], r["side"], r["doc_id"]) for r in rows})
    assert {(r["build_id"], r["side"], r["doc_id"], k): r[f"n_{k}"] for r in rows for k in ("same", "equal", "near") if r[f"n_{k}"]} == dict(partners)


# --- packing -------------------------------------------------------------------


def test_best_fit_and_evolution():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 101) for _ in range(300)]
    order = sorted(range(300), key=lambda i: -sizes[i])
    base = containers.packed(order, sizes, 100)
    best = containers.evolve(sizes, 100, 1, [])
    for p in (base, best):
        assert sorted(i for b in p.bins for i in b) == list(range(300)) and max(p.fill) <= 100 and p.fill == [sum(sizes[i] for i in b) for b in p.bins]
    assert len(best.bins) <= len(base.bins) and len(containers.evolve(sizes, 100, 2, [best]).bins) <= len(best.bins)
    assert containers.evolve([], 10, 0, []).bins == [] and len(containers.evolve([10, 10], 10, 0, []).bins) == 2


@pytest.mark.parametrize("low, high, gained", [(820, 2457, 5), (1024, 2048, 15), (1229, 1638, 15)])
def test_evolution_beats_best_fit_on_hard_sizes(low, high, gained):
    """Sizes of 20 to 60 %, 25 to 50 % and 30 to 40 % of a window: best fit by falling size wastes room that the search finds."""
    rng = random.Random(19)
    sizes = [rng.randrange(low, high) for _ in range(1000)]
    base = containers.packed(sorted(range(1000), key=lambda i: -sizes[i]), sizes, 4096)
    best = containers.evolve(sizes, 4096, 1, [])
    assert len(base.bins) - len(best.bins) >= gained and len(best.bins) >= containers.least_windows(sizes, 4096)


def test_least_windows():
    """The bound holds for every packing of small cases, and counts items that can't meet."""
    rng = random.Random(20)
    for _ in range(200):
        cap = rng.randrange(5, 30)
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 8))]
        best = len(sizes)
        for order in itertools.permutations(range(len(sizes))) if len(sizes) < 7 else [range(len(sizes))] * 0:
            windows, room = 0, 0
            for i in order:
                if sizes[i] > room:
                    windows, room = windows + 1, cap
                room -= sizes[i]
            best = min(best, windows)
        assert containers.least_windows(sizes, cap) <= best
    assert containers.least_windows([6] * 9, 10) == 9 and containers.least_windows([10, 1], 10) == 2 and containers.least_windows([], 10) == 0


def test_fill_windows(spark, monkeypatch):
    monkeypatch.setattr(containers, "BLOCK", 40)
    rng = random.Random(6)
    rows = [(i, "r1" if i % 3 else "r2", rng.choice([0, -1, None, 1, 7, 63, 64, 65, 64 * 3, 200, rng.randrange(1, 64)]), i) for i in range(300)]
    schema = "report_id long, run_id string, n_tokens int, received_at long"
    reports = spark.createDataFrame(rows + [(5, "r1", 999, 10_000), (900, None, 5, 1), (901, "other", 5, 1)], schema).withColumn("window", F.lit(1))
    runs = spark.createDataFrame([("r1", 64), ("r2", 100), ("r3", 10)], "run_id string, max_seq_len int")
    windows = containers.fill_windows(reports, runs)
    got = windows.collect()
    want = {i: n for i, _, n, _ in rows if n and n > 0}
    parts = {}
    for r in got:
        parts.setdefault(r["report_id"], []).append((r["start"], r["n_tokens"], r["max_seq_len"]))
    assert set(parts) == set(want)
    for i, ps in parts.items():
        at = 0
        for start, n, cap in sorted(ps):
            assert start == at and n <= cap
            at += n
        assert at == want[i] and (len(ps) == 1 or want[i] > ps[0][2])
    fill = {}
    for r in got:
        fill[r["run_id"], r["window"]] = fill.get((r["run_id"], r["window"]), 0) + r["n_tokens"]
    assert all(n <= (64 if run == "r1" else 100) for (run, _), n in fill.items())
    for r in containers.filling(windows).collect():
        assert r["least_windows"] <= r["n_windows"] <= r["least_windows"] * 1.15 + 2
    assert containers.fill_windows(spark.createDataFrame([], schema), runs).count() == 0


# --- truncation ----------------------------------------------------------------


def test_limits_found(spark):
    lengths = [("s", "c", x, 1) for x in range(100, 300, 7)] + [("s", "c", 250, 30), (None, "b", 90, 1)]
    found = truncation.find_limits(spark.createDataFrame(lengths, "source string, unit string, length int, n long").groupBy("source", "unit", "length").agg(F.sum("n").alias("n")))
    assert [tuple(r) for r in found.collect()] == [("s", "c", 250)]


def test_limits_of_any_length(spark):
    """A source's limit is found below 40 characters and beyond 100,000, and ordinary short values make none."""
    rng = random.Random(15)
    schema = "sample_id long, source string, field string, turn int, value string"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n // 4 + 9))[: n - 1] + "x"
    rows = [("short", text(32)) for _ in range(12)] + [("forty", text(40)) for _ in range(12)] + [("long", text(131_072)) for _ in range(6)]
    rows += [(s, text(rng.randrange(20, 400))) for s in ("short", "forty", "long") for _ in range(60)]
    rows += [("plain", text(k)) for k in range(2, 30) for _ in range(6)]
    values = spark.createDataFrame([(i, s, "output", -1, v) for i, (s, v) in enumerate(rows)], schema)
    limits = truncation.fit_truncation(values).limits
    assert {k[0]: v for k, v in limits.items() if k[1] == "c"} == {"short": [32], "forty": [40], "long": [131_072]}


@pytest.fixture(scope="module")
def cut_model(spark):
    sf = SF.replace("0.001", "0.01")
    cells = truncation.values(spark.read.parquet(f"{sf}/alpaca_samples.parquet"), spark.read.parquet(f"{sf}/chat_samples.parquet"))
    return truncation.fit_truncation(cells)


def test_truncation_on_held_out_cuts(spark, cut_model):
    """Intact answers of another table, cut inside a word or not."""
    intact = [r["output"] for r in spark.read.parquet("/root/testdata/sf0.1/alpaca_samples.parquet").select("output").where("length(output) > 120 and output rlike '[.]$'").limit(600).collect()]
    rng = random.Random(7)
    cuts = []
    for t in intact:
        x = rng.randrange(60, len(t) - 20)
        if t[x - 1].isalpha() and t[x].isalpha():
            cuts.append(t[:x])
    kept = np.mean([cut_model.score("lab_notes", t) > 0.5 for t in intact])
    found = np.mean([cut_model.score("lab_notes", t) > 0.5 for t in cuts])
    assert kept < 0.01 and found > 0.93


def test_cut_log_records(cut_model):
    """A log cut inside its last record is found, a whole one isn't."""
    record = "2031-02-0{}T08:43:33Z relay-{}.ops.example fwd[10{}5]: rate limit hit from 192.0.2.{}7"
    log = "The log shows it.\n" + "\n".join(record.format(i, i, i, i) for i in range(1, 6))
    assert cut_model.score("qa_dump", log) < 0.5 and not truncation.odd_record(log)
    for end in (" hit from 192.0.2.57", " from 192.0.2.57", "mit hit from 192.0.2.57"):
        assert cut_model.score("qa_dump", log.removesuffix(end)) > 0.5 and truncation.odd_record(log.removesuffix(end)), end
    assert not truncation.odd_record("") and not truncation.odd_record("2031-02-01T08:43:33Z alone")


@pytest.mark.parametrize("text", [None, "", "  \n", "TCP", "443", "see https://docs.example/a/1", "```python\nx = 1\n```", "the alarm was muted late on friday."])
def test_complete_values(cut_model, text):
    assert cut_model.score("qa_dump", text) <= 0.5


def test_score_values_edges(spark, cut_model):
    schema = "sample_id long, source string, field string, turn int, value string"
    rows = [(1, None, "output", -1, "Here is the script that you asked for.\n```python\nfor x in range(3):\n    pri"), (1, None, "output", -1, "Here is the script that you asked for.\n```python\nfor x in range(3):\n    pri"), (2, "s", "output", -1, "word " * 20_000 + "end.")]
    scored = truncation.score_values(spark.createDataFrame(rows, schema).withColumn("odds", F.lit("x")), cut_model)
    assert scored.count() == 3
    rates = {r["source"]: (r["n_values"], r["n_truncated"]) for r in truncation.truncation_rates(scored).collect()}
    assert rates == {None: (1, 1), "s": (1, 0)}
    empty = spark.createDataFrame([], schema)
    assert truncation.score_values(empty, truncation.fit_truncation(empty)).count() == 0


# --- defects -------------------------------------------------------------------


@pytest.mark.parametrize("answer", [None, "", " \t\n", "​", "﻿", "n/a", "N/A", "-", "...", '""', "TBD", "null", "None", "<blank>", "(empty)", "[no response]"])
def test_empty(answer):
    assert sum(v > 0 for v in defects.votes_empty(answer)) >= 2


@pytest.mark.parametrize("answer", ["TCP", "443", "true", "No", "Yes.", "Option B", "0x2f86", "flush_route_v2()", "192.0.2.54", "Нет", "Keine", "Ninguno", "word " * 5000])
def test_short_answers_are_answers(answer):
    assert all(v < 0 for v in defects.votes_empty(answer))
    assert all(v <= 0 for v in defects.votes_refusal("Which port?", answer))


def test_refusals():
    ask = "Which steps help against token theft on the badge system?"
    for bad in ("I'm sorry, but I can't help with that.", "Request declined by policy.", "Leider kann ich diese Frage nicht beantworten.", "Je ne peux pas répondre à cette demande.", "Lo siento, no puedo ayudar con eso.", "Let's talk about something different."):
        assert sum(defects.votes_refusal(ask, bad)) > 0, bad
    filler = "A signal handler maps 57 entries onto a signal handler."
    for bad in (f"{filler} I'm sorry, but I have to pass on this one. Please consult a qualified professional instead. Feel free to ask about another topic.", "Regrettably, I'd rather not go into this. I hope you understand."):
        assert sum(defects.votes_refusal(ask, bad)[0::3]) > 0, bad
    for good in ("You cannot recover a key from its digest, so store it elsewhere. " * 3, "The service is not able to start unless data masking is active on the badge system."):
        assert sum(defects.votes_refusal(ask, good)) < 0, good


def test_long_refusals():
    ask = "Which steps help against token theft on the badge system?"
    refusals = (
        "I'm sorry, but I can't help with that request. Our safety guidelines do not allow me to describe how such an attack is stopped or carried out. I understand that this may be frustrating, and I appreciate your patience. If you like, I would be happy to talk about other topics, such as how a team can plan its training or write clear reports. Please let me know what you would like to discuss instead.",
        "Thank you for your question. I understand that the matter is important to you and your colleagues. Unfortunately, I am not able to answer it, because the rules that I follow forbid me to discuss the protection of badge systems in any detail. I can gladly help you with other questions about the company, its offices and its services. Please feel free to ask.",
        "Es tut mir leid, aber diese Frage kann ich Ihnen leider nicht beantworten. Unsere Richtlinien erlauben mir nicht, über den Schutz von solchen Anlagen zu sprechen, auch wenn der Grund für die Frage ein guter ist. Ich bitte dafür um Ihr Verständnis und um etwas Geduld. Gerne spreche ich mit Ihnen über andere Themen, etwa über die Planung von Schulungen.",
    )
    for bad in refusals:
        assert len(bad.split()) > 50 and defects.votes_refusal(ask, bad) == (1, 1, 1, 1), bad
        assert sum(defects.votes_refusal("Write a letter to decline the offer of the supplier.", bad)) < 0
    assert all(defects.votes_refusal(ask, bad) == (1, 1, 1, 1) for bad in defects._LONG_REFUSALS)
    short = "I'm sorry, but I can't help with that."
    for padded in (" " * 90 + short, short + " " * 90, short.replace(" ", " " * 12), short.replace(" ", "\n" + " " * 12, 2)):
        assert defects.votes_refusal(ask, padded) == defects.votes_refusal(ask, short)
    answers = (
        "I can't give legal advice, but these steps help. Rotate the signing keys every month and bind each token to the device that asked for it. Keep the lifetime of a token short. Log each use with the reader and the time. Alert the guard when one badge is used at two doors within a minute.",
        "A stolen token cannot be used when it is bound to a device. " * 8,
        "Unfortunately, the badge system cannot tell a copied token from a real one. Bind tokens to the readers, rotate the keys each month and shorten the lifetime. " * 3,
    )
    for good in answers:
        assert len(good.split()) > 45 and sum(defects.votes_refusal(ask, good)) < 0, good


def test_copies():
    ask = "How would you use hardware keys to protect a build server from port knocking?"
    for bad in (ask, ask.upper(), f"{ask}\n\n{ask}", f"User: {ask}", f"You asked: “{ask}”", "How you would use hardware keys to protect a build server port knocking?"):
        assert sum(defects.votes_copy(ask, "", bad)) > 0, bad
    for good in (f"{ask} Keep the keys in a safe, rotate them each month, log every use and alert on failures.", "Keep the keys in a safe.", ""):
        assert sum(defects.votes_copy(ask, "", good)) < 0, good
    assert sum(defects.votes_copy("Correct spelling and punctuation of the input.", "on corxiter boards the bus holds 57 slots", "On Corxiter boards the bus holds 57 slots.")) < 0


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    return language.fit_languages(docs.select(F.col("doc_id").alias("id"), "text", "lang"), sample=2500)


def test_language_model_on_held_out_documents(spark, languages):
    """Sentences of documents that weren't drawn, with clean labels; uneven labels have made no languages of their own."""
    assert languages.languages == ("de", "en", "es", "fr", "pt", "ru")
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where("lang in ('de', 'en', 'es', 'fr', 'pt', 'ru')").select("text", "lang").collect()
    texts = [" ".join(r["text"].split()[:25]) for r in rows]
    words, letters, n = languages.score(texts)
    for scores, least in ((words, 0.96), (letters, 0.93)):
        best = language.leading(scores, 3.0)
        known = best >= 0
        right = [languages.languages[i] == r["lang"] for i, r in zip(best, rows, strict=True) if i >= 0]
        assert known.mean() > 0.9 and np.mean(right) > least


def test_language_edges(spark, languages):
    words, letters, n = languages.score(["", "   ", "split_schema_once() 0x12 10.0.0.1 svc-1", "der die das " * 20_000])
    assert not words[:3].any() and not n[:3].any() and n[3] == 60_000
    assert language.leading(words, 3.0).tolist()[:3] == [-1, -1, -1]
    empty = spark.createDataFrame([], "id long, text string, lang string")
    none = language.fit_languages(empty)
    assert none.languages == () and defects.votes_language(none, ["a"], [""], ["b"]) == [(0, 0, 0)]
    odd = spark.createDataFrame([(1, "a b c", "en"), (2, None, "de"), (3, "x", None), (None, "y", "fr"), (4, "z", "unknown")], "id long, text string, lang string").withColumn("label", F.lit(1))
    assert language.fit_languages(odd).languages == ()


def test_languages(languages):
    english, german = "Why did the alarm fail when the operator was on leave?", "Der Betreiber war im Urlaub und niemand hat die Anlage geprüft, weil die Regel zu weit war."
    vote = lambda p, x, a: sum(defects.votes_language(languages, [p], [x], [a])[0])
    assert vote(english, "", german) > 0
    assert vote(english + " Please reply in German only.", "", german) < 0
    assert vote("Translate the text into German.", "Nobody checked the plant because the rule was too broad.", german) < 0
    assert vote("Rewrite the text.", german, german) <= 0
    assert vote(english, "", "Because the rule was too broad and nobody had read the report.") < 0
    assert vote(english, "", f"The note said: “{german}” and nobody read it before the operator came back to the plant.") <= 0
    for short in ("0x496b8e9c", "TCP", "Option B", "split_schema_once()", ""):
        assert vote(english, "", short) <= 0 and vote("Welche Schritte helfen trotz Warnung?", "", short) <= 0


def test_prompts_teach_the_language_model(spark, languages):
    """Words that no document has are learnt from prompts by the language of their answers."""
    ask = ["Blorft quandle zim", "Wuggle frip snarl"]
    answers = {0: "Because the rule was too broad and nobody had read the report before the shift ended.", 1: "Weil die Regel zu weit war und niemand den Bericht vor dem Ende der Schicht gelesen hat."}
    rows = [(ask[i % 2], answers[i % 2]) for i in range(80)]
    more = language.taught(languages, spark.createDataFrame(rows, "a string, b string"))
    best = language.leading(more.score(ask)[0], 3.0)
    assert [more.languages[i] for i in best] == ["en", "de"]


def test_refusal_classifier_beyond_phrases(spark):
    """Trained on answers that the phrases give away, it votes for refusals that hold no such phrase, and against answers."""
    known = ("I'm sorry, but I can't help with that. Is there anything else you would like to know?", "Unfortunately, I am not able to assist with this request. Please consult a professional instead.", "Sorry, I won't answer that. Feel free to ask about another topic.")
    subjects = ("router", "printer", "ledger", "archive", "sensor", "gateway", "console", "bucket", "scanner", "portal")
    rows = [(f"How is the {s} kept safe?", f"The {s} is locked by key {i} and the {t} logs each use of it.") for i, s in enumerate(subjects) for t in subjects]
    rows += [("How is it kept safe?", k) for k in known for _ in range(12)]
    model = defects.fit_refusals(spark.createDataFrame(rows, "prompt string, answer string"))
    held_out = ("Sorry, this isn't a request that gets help here. Is there anything else you would like to know?", "Unfortunately that is no topic for me. Please consult a professional instead.")
    for text in held_out:
        assert max(defects.votes_refusal("How is it kept safe?", text)[0::3]) < 1 and model.vote(text) == 1, text
    assert all(model.vote(f"The {s} is kept in a safe place and logs each use.") == -1 for s in subjects)
    assert model.vote("") <= 0 and model.vote("word " * 5000) == 0 and defects.RefusalModel().vote("Sorry") == 0
    assert defects.fit_refusals(spark.createDataFrame([], "prompt string, answer string")).weights is None


def test_label_model():
    rng = random.Random(8)
    counts = Counter()
    truth = Counter()
    for _ in range(5000):
        y = rng.random() < 0.1
        v = tuple((1 if (rng.random() < acc) == y else -1) if rng.random() < 0.9 else 0 for acc in (0.95, 0.9, 0.85))
        counts[defects.code(v)] += 1
        truth[defects.code(v)] += y
    post = defects.label_model(counts, 3)
    assert post[defects.code((1, 1, 1))] > 0.9 and post[defects.code((-1, -1, -1))] == 0 and post[defects.code((0, 0, 0))] == 0
    assert all(abs(post[k] - truth[k] / counts[k]) < 0.35 for k in counts if counts[k] > 50)
    assert all(defects.code(tuple(defects.decode(k, 3))) == k for k in range(27)) and defects.label_model({}, 3) == {}


def test_find_defects(spark, cut_model):
    a = spark.createDataFrame([(1, "s", "Why?", None, None), (1, "s", "Why?", None, None), (2, None, None, None, "Because."), (3, "s", "Name the port that the badge system needs.", "", "Name the port that the badge system needs.")], "sample_id long, source string, instruction string, input string, output string").withColumn("defect", F.lit(1))
    message = "sample_id long, source string, messages array<struct<role:string,content:string>>"
    c = spark.createDataFrame([(10, "s", [("user", "Hi there"), ("assistant", "")]), (11, "s", [("assistant", "")]), (12, "s", None), (13, "s", []), (14, "s", [("user", "Q"), ("tool", "x"), ("assistant", "")])], message)
    voters = defects.fit_voters(a, c, cut_model)
    found, cutoffs = defects.find_defects(a, c, voters)
    assert {tuple(r)[:3] for r in found.collect()} == {(1, -1, "empty"), (3, -1, "copy"), (10, 1, "empty")} and set(cutoffs) == set(defects.DEFECTS)
    none, _ = defects.find_defects(a.limit(0), c.limit(0), defects.fit_voters(a.limit(0), c.limit(0), cut_model))
    assert none.count() == 0


def test_cutoffs_come_from_all_answers(spark, monkeypatch):
    """Every pair with prompt and answer is spoiled once, however many there are, and a vote on one defect is that of all votes."""
    seen, validated = [], defects._validated
    monkeypatch.setattr(defects, "_validated", lambda base, *a: seen.append(base.count()) or validated(base, *a))
    a = spark.range(6000).select(F.col("id").alias("sample_id"), F.lit("s").alias("source"), F.lit("Why?").alias("instruction"), F.lit("").alias("input"), F.concat(F.lit("Because of part "), "id").alias("output"))
    c = spark.createDataFrame([], "sample_id long, source string, messages array<struct<role:string,content:string>>")
    voters = defects.Voters(truncation.fit_truncation(truncation.values(a.limit(0), c)), language.no_languages(), defects.RefusalModel())
    defects.find_defects(a, c, voters)
    assert seen == [6000]
    for answer in ("n/a", "Why is that?", "I can't help with that.", "Because of part 7"):
        every = voters.votes(["s"], ["Why is that so?"], [None], [answer])[0]
        assert [voters.votes_on([d], ["s"], ["Why is that so?"], [None], [answer])[0] for d in defects.DEFECTS] == [every[d] for d in defects.DEFECTS]


def test_votes_and_cutoffs_take_one_pass(spark, languages, cut_model, monkeypatch):
    """Answers and their spoiled copies are voted on in one pass, which reads the languages of a text once and votes as separate passes do."""
    a, c = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("alpaca_samples", "chat_samples"))
    rows = defects.pairs(a, c).orderBy("sample_id", "turn").limit(400).collect()
    columns = [[r[x] for r in rows] for x in ("source", "prompt", "extra", "answer")]
    sources, prompts, extras, answers = columns
    voters = defects.Voters(cut_model, languages, defects.RefusalModel())
    whole = [k for k, r in enumerate(rows) if r["prompt"] is not None and r["answer"] is not None]
    of = lambda texts: language.leading(languages.score([defects.prose(t) for t in texts])[0], 3.0)
    of_prompt, of_answer = of([prompts[k] for k in whole]), of([answers[k] for k in whole])
    expected: list[dict] = [{} for _ in rows]
    for i, k in enumerate(whole):
        far = next((answers[whole[j]] for j in range(i + 1, min(len(whole), i + 40)) if of_prompt[i] >= 0 and of_answer[j] >= 0 and of_answer[j] != of_prompt[i]), "")
        made = defects.spoil(prompts[k], answers[k], "" if defects._ASKS_LANGUAGE.search(prompts[k]) else far, random.Random(f"{prompts[k]}/{answers[k]}"))
        n = len(made)
        expected[k] = dict(zip([d for d, _ in made], voters.votes_on([d for d, _ in made], [sources[k]] * n, [prompts[k]] * n, [extras[k]] * n, [x for _, x in made]), strict=True))
    every = voters.votes(*columns)
    scored, score = [], language.LanguageModel.score
    monkeypatch.setattr(language.LanguageModel, "score", lambda self, texts: scored.extend(texts) or score(self, texts))
    assert list(voters.votes_and_spoiled(*columns)) == list(zip(every, expected, strict=True))
    assert all(sum(d in x for x in expected) > 100 for d in defects.DEFECTS)
    reworded = sum(bool((x or "").strip() and defects._ASKS_REWORDING.search(p or "")) for p, x in zip(prompts, extras, strict=True))
    assert len(scored) == len(rows) + reworded + sum(bool(x) for r in answers for x in defects._SENTENCE.split(defects.prose(r or "")))
    passes, frame = [], type(a)
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(frame, name, lambda self, *args, _call=getattr(frame, name), **more: passes.append(1) or _call(self, *args, **more))
    defects.find_defects(a, c, voters)
    assert len(passes) == 1


def test_closed_answers_can_be_cut(spark, cut_model):
    """Truncated answers of p5 are those of p2, whatever they end with."""
    answers = ["The relay needs at least version 4.", "Set the lifetime of the token to v2.", "It listens on port 443 and on", "Keep the keys in a safe."]
    a = spark.createDataFrame([(i, "s", "Which version?", "", x) for i, x in enumerate(answers * 5)], "sample_id long, source string, instruction string, input string, output string")
    c = spark.createDataFrame([], "sample_id long, source string, messages array<struct<role:string,content:string>>")
    model = truncation.TruncationModel(**{**cut_model.state(), "bias": cut_model.bias + 1.5})
    for m in (cut_model, model, truncation.TruncationModel(**{**cut_model.state(), "bias": 60.0})):
        cut = {r["sample_id"] for r in truncation.score_values(truncation.values(a, c), m).where("truncated").collect()}
        found, _ = defects.find_defects(a, c, defects.Voters(m, language.no_languages(), defects.RefusalModel()))
        assert {r["sample_id"] for r in found.where("defect = 'truncated'").collect()} == cut
    assert len(cut) == 20


# --- leakage -------------------------------------------------------------------


def test_winnowing_guarantee():
    rng = np.random.default_rng(9)
    for _ in range(50):
        shared = rng.integers(0, 2**60, leakage.K + leakage.W - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**60, 20).astype(np.uint64), shared, rng.integers(0, 2**60, 20).astype(np.uint64)]) for _ in range(2))
        rows = np.zeros(len(a), np.int64)
        prints = [set(leakage.grams(x, rows)[0][leakage.winnow(x, rows)].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]


def test_common_sequence():
    rng = random.Random(10)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert leakage.common_sequence(a, b) == best[-1][-1]


def test_sequence_lengths_and_passages():
    rng = random.Random(21)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        assert leakage.sequence_lengths(a, b) == [leakage.common_sequence(a, b[: i + 1]) for i in range(len(b))]
    item = list(range(40))
    other = lambda n: [rng.randrange(1000, 9999) for _ in range(n)]
    # words around, and a phrase of the item some words further, are no part of the passage
    assert leakage.passage_in(item, other(3) + item + other(8) + item[5:8]) == (40, 40, 40)
    assert leakage.passage_in(item, other(3) + item[10:31] + other(3)) == (21, 21, 21)
    changed = item[10:31]
    changed[4], changed[12] = -1, -2
    assert leakage.passage_in(item, other(2) + changed) == (19, 21, 21)
    assert leakage.passage_in(item[:3], other(3) + item[:3] + other(3)) == (3, 3, 3)
    assert leakage.passage_in(item, []) == leakage.passage_in([], item) == leakage.passage_in(item, other(9)) == (0, 0, 0)


def test_no_passage_is_lost_before_the_join():
    """Every spoiled passage that the rule accepts has its grams dense enough to pass, whatever words are changed or added."""
    rng = random.Random(22)
    for _ in range(3000):
        n = rng.randrange(39, 90)
        item = np.array([rng.randrange(1 << 60) for _ in range(n)], np.uint64)
        size = rng.randrange(n // 2, n + 1)
        begin = rng.randrange(n - size + 1)
        text = item[begin : begin + size].tolist()
        for _ in range(rng.randrange(0, size // 5 + 1)):
            k = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[k] = rng.randrange(1 << 60)
            else:
                text.insert(k, rng.randrange(1 << 60))
        shared, length, span = leakage.passage_in(item.tolist(), text)
        if not (length and shared >= 0.8 * length and shared >= 0.4 * n and span + 2 * leakage.LOOSE >= 0.5 * n):
            continue
        words = np.array([*(rng.randrange(1 << 60) for _ in range(9)), *text, *(rng.randrange(1 << 60) for _ in range(9))], np.uint64)
        rows = np.zeros(len(words), np.int64)
        g = leakage.grams(words, rows)[0]
        known = np.flatnonzero(np.isin(g, leakage.grams(item, np.zeros(n, np.int64))[0]))
        assert len(leakage._within_long(known, known, rows, *leakage.least_grams(n, 0.5, 0.8))), (n, size, length, shared)


def test_leaks(spark):
    rng = random.Random(11)
    ctx = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(3000)}" for _ in range(40)) + "." for _ in range(6)]
    items = [(i, t + " Which option fits?") for i, t in enumerate(ctx)] + [(90, None), (91, ""), (0, ctx[0] + " Which option fits?")]
    fill = lambda n: " ".join(f"z{rng.randrange(900)}" for _ in range(n))
    half = ctx[1].split()[:25]
    changed = ctx[2].split()
    for k in range(5, 40, 10):
        changed[k] = "other"
    docs = [(1, fill(50) + "\n> " + ctx[0].upper().replace(" ", ",\n", 3) + " " + fill(30)), (2, fill(30) + " " + " ".join(half) + " " + fill(20)), (3, fill(9) + " " + " ".join(changed)), (4, " ".join(ctx[3].split()[:8]) + fill(40)), (5, "Which option fits?"), (6, None), (7, ""), (1, fill(3)), (8, fill(20_000) + " " + ctx[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, spark.createDataFrame(items, "item_id long, ctx string")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (8, 4)}
    assert leakage.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, ctx string")).count() == 0
    assert leakage.leaks(df, spark.createDataFrame([], "item_id long, ctx string")).count() == 0


def test_leaks_of_short_items(spark):
    """Whole short items, halves and spoiled halves have few common fingerprints and are found all the same; phrases aren't."""
    rng = random.Random(14)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(10**6)}"
    items, docs, expected = [], [], set()
    fill = lambda n: " ".join(f"z{rng.randrange(900)}" for _ in range(n))
    for i, n in enumerate(n for n in (3, 4, 5, 6, 7, 8, 9, 10, 12) for _ in range(6)):
        ctx = [word() for _ in range(n)]
        items.append((i, " ".join(ctx)))
        docs.append((i, f"{fill(40)} {' '.join(ctx)} {fill(40)}"))
        expected.add((i, i))
    for i, n in enumerate((n for n in (16, 20, 26, 36, 44) for _ in range(6)), 100):
        ctx = [word() for _ in range(n)]
        items.append((i, " ".join(ctx)))
        part = ctx[n // 5 : n // 5 + -(-55 * n // 100)]
        docs.append((i, f"{fill(40)} {' '.join(part)} {fill(40)}"))
        spoiled = ctx[: -(-n // 2) + 1]
        for k in range(n // 10):
            spoiled[(k + 1) * len(spoiled) // (n // 10 + 1)] = word()
        docs.append((1000 + i, f"{fill(40)} {' '.join(spoiled)} {fill(40)}"))
        docs.append((2000 + i, f"{fill(40)} {' '.join(ctx[:4])} {fill(40)}"))  # a phrase
        expected |= {(i, i), (1000 + i, i)}
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, ctx string")).collect()}
    assert got == expected


# --- mixing --------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(12)
    docs = [(i, rng.choice(["a", "b", "b", "b", "c", "out", None]), "word " * rng.randrange(1, 60)) for i in range(900)] + [(900, "a", None), (901, "a", ""), (0, "a", "word")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("share", F.lit(0))
    targets = spark.createDataFrame([("a", 0.3, 3), ("b", 0.3, 2), ("c", 0.4, 1), ("d", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, targets)
    rows = mixture.collect()
    assert all(r["copy"] < {"a": 3, "b": 2, "c": 1}[r["source"]] for r in rows) and len(rows) == len({(r["doc_id"], r["copy"]) for r in rows})
    by = {r["source"]: r for r in shares.collect()}
    total = sum(r["n_tokens"] for r in rows)
    budget = sum(by[s]["available_tokens"] for s in "abc")
    assert budget - 200 < total <= budget
    # c may be used once: what it lacks goes to the others in their proportions
    assert by["a"]["share"] / by["b"]["share"] == pytest.approx(1, rel=0.06)
    # the order is that of the queue: nothing left out finishes before what is in
    assert max(r["finish"] for r in rows) >= 0
    none, _ = mixing.mix(df.limit(0), targets)
    assert none.count() == 0
    fits, exact = mixing.mix(df, spark.createDataFrame([("a", 0.2, 5), ("b", 0.8, 5)], targets.schema))
    for r in exact.collect():
        assert r["share"] == pytest.approx(r["target_share"], abs=0.02)


def test_running_sums_are_whole(spark):
    """Finish times of a source are its running token counts: no document is counted twice or left out."""
    df = spark.createDataFrame([(i, "a", "word " * (i % 7 + 1)) for i in range(500)], "doc_id long, source string, text string")
    m, _ = mixing.mix(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    rows = sorted(m.collect(), key=lambda r: r["finish"])
    at = 0
    for r in rows:
        at += r["n_tokens"]
        assert r["finish"] == at
    assert len(rows) == 500


# --- encodings -----------------------------------------------------------------

CLEAN = ["Die Prüfung läuft über größere Geräte und Schlüssel", "El año pasado la dirección añadió una cámara pública", "L'hébergeur détourne la clé périmée dès la première heure à l'étage", "A direção não avisou ninguém após a revisão do relógio", "Администратор проверяет журнал доступа после перезагрузки", "The “vendor” said — perhaps — that café users can’t wait…"]


@pytest.fixture(scope="module")
def encodings():
    counts = Counter(w for t in (*CLEAN, *["12 € at 40 µs, ±3 °C, § 7"] * 5) for w in encoding._WORD.findall(t))
    return encoding.train([(w, 50 * n) for w, n in counts.items()])


def test_chains_invert():
    for chain in encoding.CHAINS:
        for text in CLEAN:
            bad = encoding.garble(text, chain)
            if bad is not None:
                back = encoding.restore(bad, chain)
                assert back is None or back == text or chain[0][0] != "utf-8"


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1251"),), (("utf-8", "mac-roman"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1252", "cp1251"),), (("cp1251", "koi8-r"),), (("cp1251", "cp1252"),)])
def test_restores(encodings, chain):
    tried = 0
    for text in CLEAN:
        bad = encoding.garble(text, chain)
        if bad is None or bad == text or encoding.restore(bad, chain) != text or sum(ord(c) > 127 for c in text) < 3:
            continue
        tried += 1
        found, _, back = encodings.document(bad)
        assert found and (back == text or chain[0][0] != "utf-8")
    assert tried


@pytest.mark.parametrize("text", [*CLEAN, "", "plain ASCII", "FÜR DIE PRÜFUNG", "A page that shows Ã© where é belongs was saved twice.", "12 € at 40 µs, ±3 °C"])
def test_intact(encodings, text):
    assert not encodings.document(text)[0]


def test_garbled_table(spark, encodings):
    bad = encoding.garble(CLEAN[0], (("utf-8", "cp1252"),))
    rows = [(1, bad), (1, bad), (2, CLEAN[0]), (3, None), (4, ""), (5, "verlor�n"), (7, "The sign � stands for what can't be read, “�” in quotation marks."), (6, CLEAN[1] * 2000 + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chains", F.lit(1))
    got = {r["doc_id"]: r["restored"] for r in encoding.garbled(df, encodings).collect()}
    assert set(got) == {1, 5, 6} and got[1] == CLEAN[0] and got[5] is None and got[6] == CLEAN[1] * 2000 + CLEAN[0]
    assert encoding.garbled(df.limit(0), encoding.fit_encoding(df.limit(0))).count() == 0


# --- queries -------------------------------------------------------------------

COLUMNS = {
    "p2_found": {"sample_id": "bigint", "field": "string", "turn": "int"},
    "p3_found": {"sample_id_a": "bigint", "sample_id_b": "bigint"},
    "p4_found": {"build_id": "bigint", "doc_id_a": "bigint", "doc_id_b": "bigint"},
    "p5_found": {"sample_id": "bigint", "turn": "int", "defect": "string"},
    "p6_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name] and df.count() == df.distinct().count()
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equals_sql(spark, name):
    """What DuckDB finds by the definitions alone."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert expected and sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == expected
