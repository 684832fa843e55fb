"""Goldens and edge cases of the core operators."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.constants import WHITESPACE
from corpusloom.functions import sampling
from corpusloom.functions.text import duration, repetition_rate, strip, words
from corpusloom.functions.tokens import in_range, marked, stub_ids
from corpusloom.operators import compare, encode, evaluation, layout, prefix, quality, render, stats, vocabulary
from corpusloom.operators.prefix import mark_smallest, running_total
from corpusloom.sources import items, lines, sinks
from corpusloom.streaming import rejects

TEXTS = "i long, text string"


def one(df):
    return df.collect()[0][0]


def test_strip_equals_python(spark):
    rows = [(i, c + "a b" + c) for i, c in enumerate(WHITESPACE)] + [(90, ""), (91, None), (92, WHITESPACE)]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, TEXTS).select("i", strip("text").alias("s")).collect()}
    assert got == {i: None if t is None else t.strip() for i, t in rows}


def test_words_equal_python(spark):
    rows = [(0, "a\u001fb  c"), (1, ""), (2, "   "), (3, "x" * 5000 + " y")]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, TEXTS).select("i", words("text").alias("w")).collect()}
    assert got == {i: t.split() for i, t in rows}


def test_stub_tokens(spark):
    rows = [(0, "aé"), (1, ""), (2, None), (3, "😀")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, TEXTS).select("i", stub_ids("text").alias("t")).collect()}
    assert got == {0: [ord("a") % 500 + 3, ord("é") % 500 + 3], 1: [], 2: None, 3: [ord("😀") % 500 + 3]}
    assert one(spark.range(1).select(in_range(F.array(F.lit(70_000))))) is False


def test_repetition(spark):
    rows = [(0, "a " * 8), (1, "a " * 20), (2, None), (3, " ".join(map(str, range(30))))]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(rows, TEXTS).select("i", repetition_rate("text").alias("r")).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(1 - 1 / 13) and got[3] == 0 and got[2] is None


@pytest.mark.parametrize("seconds, shown", [(5, "5s"), (65, "1m05s"), (3723, "1h02m03s")])
def test_duration(spark, seconds, shown):
    assert one(spark.range(1).select(duration(F.lit(seconds)))) == shown


CORPUS = [('{"text":"abc"}', None, None), ("", "-", "blank"), ("  ", "json_error", "blank"), ("{bad", "json_error", "invalid_json"), ("[1]", "not_a_dict", "missing_text_field"), ('{"x":1}', "missing_text_field", "missing_text_field"), ('{"text":null}', "missing_text_field", "invalid_text_type"), ('{"text":5}', "text_not_string: int", "invalid_text_type"), ('{"text":"  "}', "empty_text", None)]


def test_corpus_lines(spark):
    df = spark.createDataFrame([(line,) for line, _, _ in CORPUS], "line string")
    got = {r["line"]: r["reason"] for r in lines.corpus_records(df).collect()}
    assert got == {line: reason for line, reason, _ in CORPUS if reason != "-"}
    got = {r["line"]: r["reason"] for r in lines.extracted(df).collect()}
    assert got == {line: reason for line, _, reason in CORPUS}


def test_invalid_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe"),), (bytearray(b'{"text":"a"}'),)], "line binary")
    assert sorted((r["reason"] or "valid") for r in lines.extracted(df).collect()) == ["invalid_unicode", "valid"]


def test_lines_from_files_and_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(line for line, _, _ in CORPUS))
    batch = quality.rejects_by_reason(lines.corpus_records(lines.read_lines(spark, str(tmp_path)))).collect()
    counts = {r["reason"]: r["n"] for r in batch}
    assert counts == {"json_error": 2, "missing_text_field": 2, "not_a_dict": 1, "text_not_string": 1, "empty_text": 1}
    rejects.run_once(rejects.reason_counts(rejects.line_stream(spark, str(tmp_path))), "reasons")
    streamed = {r["reason"]: r["n"] for r in spark.table("reasons").collect()}
    assert streamed == {**counts, "valid": 1}


def test_sample_lines(spark):
    rows = ['{"instruction":"a","output":"b"}', "", "# x", "{bad", '{"messages":[{"role":"user","content":"q"}]}', '{"messages":[]}', '{"instruction":"a"}', '{"messages":[{"role":"user"}],"instruction":"a","output":"b"}']
    df = spark.createDataFrame(list(enumerate(rows)), "n int, line string")
    assert [(r["n"], r["format"]) for r in lines.samples(df, "n", 5).collect()] == [(0, "alpaca"), (4, "conversation")]


MESSAGES = "i int, messages array<struct<role:string,content:string>>"
CHATS = [
    (0, [("user", "q"), ("assistant", "a")]),
    (1, []),
    (2, None),
    (3, [("user", "q"), ("assistant", " ")]),
    (4, [("narrator", "x"), ("user", "q"), ("assistant", None)]),
    (5, [("assistant", "a")]),
    (6, [("user", "q")]),
]


def test_conversation_errors(spark):
    got = {r["i"]: r["e"] for r in spark.createDataFrame(CHATS, MESSAGES).select("i", quality.conversation_errors(F.col("messages")).alias("e")).collect()}
    assert got[0] == [] and got[1] == got[2] == ["messages missing or empty"] and len(got[3]) == 1 and len(got[4]) == 2
    assert got[5] == ["no user turn"] and got[6] == ["no assistant turn"]


def test_strict_validation(spark):
    df = spark.createDataFrame(CHATS, MESSAGES)
    assert quality.validate(df.where("i = 0"), quality.conversation_errors(F.col("messages")), True, "i").count() == 1
    with pytest.raises(Exception, match="index 1"):
        quality.validate(df, quality.conversation_errors(F.col("messages")), True, "i").collect()


def segments(spark, messages, **options):
    df = spark.createDataFrame([(0, messages)], MESSAGES)
    return [tuple(s) for s in one(df.select(render.conversation_segments(F.col("messages"), **options)))]


def test_segments(spark):
    two = [("user", "Q1"), ("assistant", "A1"), ("user", "Q2"), ("assistant", "A2")]
    assert [t for t, target in segments(spark, two) if target] == ["A1", "A2"]
    assert segments(spark, [("user", "Q")])[-1] == ("### Assistant:\n", False)
    assert segments(spark, [("user", "Q")], template=True) == [("", False), ("### User:\nQ\n\n", False)]
    assert segments(spark, [("system", "S"), ("user", "Q")])[0] == ("System: S\n\n", False)
    assert segments(spark, [("user", "Q"), ("system", "S")])[-1] == ("### System:\nS\n\n", False)
    assert segments(spark, two, final_response=False)[-1] == ("### Assistant:\n", False)
    assert segments(spark, [("assistant", "A")]) == [("### Assistant:\n", False), ("A", True), ("\n\n", False)]
    assert segments(spark, []) == [] and segments(spark, None) == []


def test_offsets_rebuild_text(spark):
    df = spark.createDataFrame([(0, "Q", None, "Answer text")], "i int, a string, b string, c string")
    s = one(df.select(render.with_offsets(render.alpaca_segments(F.col("a"), F.col("b"), F.col("c")))))
    text = "".join(x["text"] for x in s)
    assert [text[x["char_start"] : x["char_end"]] for x in s] == [x["text"] for x in s] and s[1]["is_target"]


def test_encoding_goldens(spark):
    df = spark.createDataFrame([([("H", False), ("A", True)],)], "s array<struct<text:string,is_target:boolean>>")
    ids, labels = encode.encode_segments(F.col("s"), 100)
    r = df.select(ids.alias("i"), labels.alias("l")).first()
    assert (r["i"][0], r["l"][0], r["i"][-1], r["l"][-1]) == (2, -100, 3, 3) and len(r["i"]) == 4
    short = df.select(encode.encode_segments(F.col("s"), 2)[1].alias("l")).select(quality.trainable(F.col("l")))
    assert one(short) is False


def test_collate_goldens(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3, 4], [1, 2, 3, 4]), (0, 1, [1, 2], [1, 2])], "b int, i int, input_ids array<int>, labels array<int>")
    got = {r["i"]: r for r in layout.collate(df, "b", 0).collect()}
    assert got[0]["attention_mask"] == [1, 1, 1, 1] and got[1]["attention_mask"] == [1, 1, 0, 0]
    assert got[1]["input_ids"] == [1, 2, 0, 0] and got[1]["labels"] == [1, 2, -100, -100]
    assert {len(r["input_ids"]) for r in layout.collate(df, "b", 0, 3).collect()} == {3}


def test_mask_report(spark):
    df = spark.createDataFrame([([-100, -100, 3, 4],), ([-100],), ([],)], "l array<int>")
    got = [tuple(r["r"]) for r in df.select(stats.mask_report(F.col("l")).alias("r")).collect()]
    assert got == [(4, 2, 2, 0.5, 2), (1, 0, 1, 0.0, 1), (0, 0, 0, 0.0, 0)]


def docs(spark, lists, schema="doc_id long, tokens array<int>"):
    return spark.createDataFrame(list(enumerate(lists)), schema)


def test_windows_golden(spark):
    w = layout.shifted_windows(docs(spark, [list(range(0, 400)), [], list(range(400, 1000))]), 16).orderBy("window_id").collect()
    assert len(w) == 62 and [r["x"][0] for r in w] == list(range(0, 992, 16)) and all(r["y"] == [t + 1 for t in r["x"]] for r in w)
    assert layout.shifted_windows(docs(spark, [[1]]), 16).count() == 0
    assert layout.shifted_windows(spark.createDataFrame([], "doc_id long, tokens array<int>"), 16).count() == 0


def test_packing_against_loop(spark):
    lists = [[5, 6, 7], [], [8, 3], list(range(10, 40)), [3]]
    flat = []
    for t in lists:
        # an empty document has no last token: it gets an end token as well
        flat += t if t and t[-1] == 3 else [*t, 3]
    for pad in (False, True):
        got = [r["tokens"] for r in layout.packed_windows(docs(spark, lists), 8, pad=pad).orderBy("window_id").collect()]
        expected = [flat[i : i + 8] for i in range(0, len(flat), 8)]
        expected = [x + [3] * (8 - len(x)) for x in expected] if pad else [x for x in expected if len(x) == 8]
        assert got == expected


def test_document_ids_and_masks(spark):
    df = docs(spark, [[7, 3, 8, 9, 3, 4]]).withColumnRenamed("doc_id", "window_id")
    assert one(df.select(layout.document_ids(F.col("tokens")))) == [0, 0, 1, 1, 1, 2]
    assert one(df.select(layout.visible_keys(F.col("tokens")))) == [1, 2, 1, 2, 3, 1]
    assert [(r["doc"], r["n"], r["n_visible"]) for r in layout.visible_totals(df).orderBy("doc").collect()] == [(0, 2, 3), (1, 3, 6), (2, 1, 1)]
    closed = docs(spark, [[3, 7, 3], []]).orderBy("doc_id")
    assert [r[0] for r in closed.select(layout.document_ids(F.col("tokens"))).collect()] == [[0, 1, 1], []]


def test_running_total_and_split(spark):
    df = spark.createDataFrame([(i * 1000, 2) for i in range(50)] + [(None, 5)], "k long, v long")
    got = {r["k"]: r["t"] for r in running_total(df, "k", "v", "t").collect()}
    assert got == {None: 0, **{i * 1000: 5 + 2 * i for i in range(50)}}
    marked_rows = mark_smallest(df.where("k is not null"), F.md5(F.col("k").cast("string")), "k", F.lit(7), "m")
    import hashlib

    expected = sorted(range(0, 50_000, 1000), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))[:7]
    assert sorted(r["k"] for r in marked_rows.where("m").collect()) == sorted(expected)
    with pytest.raises(ValueError):
        layout.split_documents(df, 1, 1.5, "k")


def test_ranks_and_running_values_against_lists(spark):
    """Ranks, rows before, smallest values before and quantiles of rows with nulls, ties and a key that a third of the rows have."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([7, 7, rng.randrange(50)]), rng.choice([None, rng.random()])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, k long, v double").withColumn("_x", F.lit(1))
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["i"]: r["place"] for r in prefix.ranked(df, F.desc("k"), "i", out="place").collect()}
    assert got == {r[0]: n for n, r in enumerate(ordered, 1)}
    by_id = [r[2] for r in sorted(rows)]
    before = {r["i"]: r["b"] for r in prefix.previous(df, "i", "v", "b").collect()}
    assert before == {i: by_id[i - 1] if i else None for i in range(400)}
    least = {r["i"]: r["b"] for r in prefix.least_before(df, "i", "v", "b").collect()}
    assert least == {i: min((v for v in by_id[:i] if v is not None), default=None) for i in range(400)}
    q = prefix.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()
    known = sorted(v for v in by_id if v is not None)
    assert q["n"] == len(known)
    for name, share in (("q0", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 1.0)):
        at = share * (len(known) - 1)
        lo = int(at)
        assert q[name] == pytest.approx(known[lo] + (known[min(lo + 1, len(known) - 1)] - known[lo]) * (at - lo))
    empty = df.limit(0)
    assert prefix.ranked(empty, "i", out="r").count() == 0 and prefix.quantiles(empty, "v", [0.5]).first()["q0"] is None
    assert stats.upper_median(empty, "v").first()["n"] == 0 and stats.upper_median(df, "v").first()["upper_median"] == known[len(known) // 2]


@pytest.mark.parametrize("size, overlap, seed", [(4, 0, 1), (4, 1, 2), (64, 1, 3), (1000, 0, 4), (7, 1, 5)])
def test_windows_against_lists(spark, size, overlap, seed):
    """Windows smaller and larger than blocks, documents longer than many windows, empty ones and null keys."""
    import random

    rng = random.Random(seed)
    docs = [(i * rng.choice([1, 1000]) * 1000 + i, [rng.randrange(60_000) for _ in range(rng.choice([0, 1, 3, 10, 90]))]) for i in range(60)]
    docs = list({k: v for k, v in docs}.items())
    df = spark.createDataFrame([*docs, (None, [1, 2]), (5_000_000_000, None)], "doc_id long, tokens array<int>").withColumn("part", F.lit(1))
    stream = [t for _, v in sorted(docs) for t in v]
    wide = size + overlap
    got = {r["window_id"]: r["tokens"] for r in layout._windows(df, size, overlap, "doc_id").collect()}
    expected = {w: stream[w * size : w * size + wide] for w in range(-(-len(stream) // size))}
    assert got == expected
    assert layout._windows(df.limit(0), size, overlap, "doc_id").count() == 0


def test_offset_check_finds_faults(spark):
    good = spark.createDataFrame([(i, i * 10, i * 10 + 10) for i in range(30)], "doc_id long, start_byte long, end_byte long")
    assert tuple(compare.offset_check(good, "doc_id").first()) == (0, 0, 300)
    assert tuple(compare.offset_check(good.where("doc_id <> 7"), "doc_id").first()) == (0, 1, 300)
    moved = good.withColumn("start_byte", F.when(F.col("doc_id") == 20, 0).otherwise(F.col("start_byte")))
    assert tuple(compare.offset_check(moved, "doc_id").first()) == (1, 1, 300)
    assert compare.offset_check(good.limit(0), "doc_id").first()["n_gaps"] == 0


def test_array_parity(spark):
    df = spark.createDataFrame([(1, [1, 2], [1, 2]), (2, [1, 2], [1, 3]), (3, [1], [1, 2]), (4, None, [1]), (5, None, None), (6, [], [])], "k long, a array<int>, b array<int>")
    got = {r["k"]: (r["same"], r["first_difference"]) for r in compare.array_parity(df, "k", "a", "b").collect()}
    assert got[1] == (True, None) and got[2] == (False, 1) and got[3] == (False, 1) and got[4][0] is False and got[5] == (True, None) and got[6] == (True, None)


def test_parity_failures_move_no_ids(spark, tmp_path):
    from corpusloom.plans import corpus

    rows = [(1, "aB"), (1, "aB"), (None, "C"), (2, "ab"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus.t09_failures(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, False, 1), (1, False, 1), (None, False, 0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_encoders_of_nulls_and_long_texts(spark):
    """Null, empty and very long texts under both files of one vocabulary, and the piece vocabulary."""
    from corpusloom.functions import tokens

    rows = [(0, None), (1, ""), (2, "a b"), (3, None), (4, "word é " * 20_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "i long, text string").repartition(2)
    folder = "/opt/tokenizers"
    a, b, c = tokens.byte_encoder(f"{folder}/byte_bpe_50k.tiktoken"), tokens.json_encoder(f"{folder}/byte_bpe_50k.json"), tokens.piece_encoder(f"{folder}/piece_bpe_32k.model")
    got = {r["i"]: r for r in df.select("i", a("text").alias("a"), b("text").alias("b"), c("text").alias("c"), tokens.byte_decoder(f"{folder}/byte_bpe_50k.tiktoken")(a("text")).alias("back")).collect()}
    for i, text in rows:
        assert got[i]["a"] == got[i]["b"] and got[i]["back"] == text and (got[i]["c"] is None) == (text is None)
    assert got[0]["a"] is None and got[1]["a"] == [] and got[1]["c"] == [] and len(got[4]["a"]) > 20_000
    assert df.limit(0).select(a("text")).count() == 0


def test_multinomial(spark):
    """Shares of many draws are those of softmax(score / temperature); no temperature takes the best one; the draw is repeatable."""
    import math

    scores = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(*(F.struct(F.lit(t).alias("token"), F.lit(x).alias("logit")) for t, x in enumerate((0.0, 1.0, 2.0))))).alias("x")).select("g", "x.*")
    uniform = (F.pmod(F.xxhash64("g", "token"), F.lit(1 << 24)) + 0.5) / (1 << 24)
    draws = sampling.multinomial(scores, "g", "logit", "token", uniform, 0.5)
    share = {r["token"]: r["count"] / 4000 for r in draws.groupBy("token").count().collect()}
    weights = [math.exp(x / 0.5) for x in (0.0, 1.0, 2.0)]
    assert all(abs(share[t] - w / sum(weights)) < 0.03 for t, w in enumerate(weights))
    assert {r["token"] for r in sampling.multinomial(scores, "g", "logit", "token", uniform, 0.0).collect()} == {2}
    ties = spark.createDataFrame([(1, t, 1.0) for t in range(4)], "g long, token int, logit double")
    assert sorted(r["token"] for r in sampling.top_members(ties, "g", 2).where("in_top").collect()) == [0, 1]


def test_masked_cross_entropy(spark):
    rows = spark.createDataFrame([([0.0, 1.0], 1), ([0.0, 0.0], -100)], "x array<double>, y int")
    got = evaluation.masked_cross_entropy(rows, "x", "y").first()
    assert got["n_targets"] == 1 and got["loss"] == pytest.approx(0.3132617)
    with pytest.raises(Exception, match="all targets are ignored"):
        evaluation.masked_cross_entropy(rows.where("y < 0"), "x", "y").collect()


def test_parsed_items(spark):
    good = '{"ctx":"a","endings":[" b"," c"],"label":1}'
    lines = spark.createDataFrame([(1, "\ufeff" + good), (2, " "), (3, good.replace("}", ',"ind":7,"activity_label":"x"}'))], "line_no long, line string")
    got = {r["line_no"]: (r["id"], r["category"], r["label"]) for r in items.checked_items(items.parsed_items(lines)).collect()}
    assert got == {1: ("line_1", "unknown", 1), 3: ("7", "x", 1)}
    with pytest.raises(Exception):
        items.parsed_items(spark.createDataFrame([(1, "{bad")], "line_no long, line string")).collect()
    with pytest.raises(Exception, match="label out of range"):
        items.checked_items(items.parsed_items(spark.createDataFrame([(1, good.replace("1}", "5}"))], "line_no long, line string"))).collect()


def test_table_scope(spark):
    import os

    with session.table_scope():
        kept = session.persist_table(spark.range(3))
        path = kept._path.removeprefix("file://")
        assert os.path.isdir(path) and kept.count() == 3
    assert not os.path.exists(path)
    other = session.persist_table(spark.range(2))
    session.drop_table(other)
    session.drop_table(other)
    assert not os.path.exists(other._path.removeprefix("file://"))


def test_batches(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    assert layout.batches(df, "i", 8, True).count() == 16 and layout.batches(df, "i", 8, False).count() == 20
    assert sorted(r["i"] for r in layout.batches(df, "i", 5, True, 2, 1).collect()) == list(range(1, 20, 2))
    assert layout.evenly_spread(10, 4) == [0, 2, 5, 7] and layout.evenly_spread(3, 9) == [0, 1, 2]


def test_histogram_edges(spark):
    same = spark.createDataFrame([(5,), (5,), (0,)], "n_tokens long")
    h = {r["bin"]: r["count"] for r in stats.histogram(same, 4).collect()}
    assert h == {0: 0, 1: 0, 2: 0, 3: 2}
    empty = stats.length_stats(spark.createDataFrame([], "n_tokens long")).first()
    assert empty["n_docs"] == 0 and empty["mean"] is None and empty["n_tokens"] == 0


def test_vocabulary(spark):
    p = spark.createDataFrame([(0, "<unk>", 0.0), (1, "<s>", 0.0), (2, "<0x0A>", 0.0), (3, "<x>", 0.0), (4, "▁ab", -1.0), (5, "▁", -2.0), (6, "ab", -2.5)], "id int, piece string, score double")
    assert {r["kind"]: r["n"] for r in vocabulary.analysis(p).collect()} == {"unknown": 1, "control": 1, "byte": 1, "user-defined": 1, "normal": 3}
    assert [tuple(r) for r in vocabulary.merges(p).collect()] == [(4, 5, 6, -1.0, 1)]


def test_choices_and_ties(spark):
    s = spark.createDataFrame([(1, 0, -1.0), (1, 1, -1.0), (2, 0, -3.0), (2, 1, -1.0), (2, 1, -1.5)], "item_id int, choice int, logprob double")
    assert {r["item_id"]: r["choice"] for r in evaluation.choose(s, False).collect()} == {1: 0, 2: 1}


def test_tool_call(spark):
    df = spark.createDataFrame([([1, 11, 5, 13],), ([13, 11],), ([11, 5],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(evaluation.tool_call_body(F.col("ids"))).collect()] == [[5], None, None, None]
    calls = spark.createDataFrame([('{"name":"f"}', None), ('{"name":"f"}', "g"), ("{bad", None), (None, None)], "p string, e string")
    assert [r[0] for r in calls.select(evaluation.valid_call(F.col("p"), F.col("e"))).collect()] == [True, False, False, False]


def test_items(spark, tmp_path):
    (tmp_path / "mc_a.jsonl").write_text(json.dumps({"ctx": "c", "endings": [" a", " b"], "label": 1}) + "\n")
    read = items.checked_items(items.read_items(spark, str(tmp_path / "mc_a.jsonl"))).first()
    assert read["label"] == 1 and read["category"] == "unknown"
    assert [r["scorer"] for r in items.read_tasks(spark, str(tmp_path)).collect()] == ["multiple_choice"]
    bad = spark.createDataFrame([("c", ["a", " b"], 0, None)], "ctx string, endings array<string>, label int, activity_label string")
    with pytest.raises(Exception, match="ending without space"):
        items.checked_items(bad).collect()


def test_trim_context_fails(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "c array<int>, e array<int>")
    assert one(df.select(encode.trim_context(F.col("c"), F.col("e"), 4))) == [2, 3]
    with pytest.raises(Exception, match="fills"):
        df.select(encode.trim_context(F.col("c"), F.col("e"), 2)).collect()


def test_replace_row(spark):
    board = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    up = spark.createDataFrame([("b", 9)], "name string, v int")
    assert sorted(map(tuple, compare.replace_row(board, up, "name").collect())) == [("a", 1), ("b", 9)]
    with pytest.raises(Exception, match="no single row"):
        compare.replace_row(board, spark.createDataFrame([("c", 9)], "name string, v int"), "name").collect()


def test_sinks(spark, tmp_path):
    d = docs(spark, [[1, 2], [], [3, 65535]])
    sinks.write_tokens(d, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/index")).agg(F.max("end_byte")).first()[0] == 8
    assert bytes(sinks.token_bytes(d).where("doc_id = 2").first()["data"]) == b"\x03\x00\xff\xff"
    sinks.write_split(layout.split_documents(d, 1, 0.5), str(tmp_path / "s"), 1, 0.5)
    assert spark.read.parquet(str(tmp_path / "s/data")).count() == 2 and spark.read.json(str(tmp_path / "s/split")).first()["n_docs_val"] == 1
    (tmp_path / "f.bin").write_bytes(b"x")
    assert sinks.file_hash(spark, str(tmp_path / "f.bin")).first()["name"] == "f.bin"


def test_log_and_listing(spark):
    df = spark.createDataFrame([("Validation  step=500  val_loss=3.99",), ("step=   500  loss=1 tok/s=184,084",), ("x",)], "line string")
    assert [tuple(r)[1:] for r in items.training_log(df).collect()] == [(500, 3.99, None), (500, None, 184084), (None, None, None)]
    ls = spark.createDataFrame([("│ a.bin │ file │ 12 │",), ("│ d │ dir │",), ("",)], "line string")
    assert {r["name"]: r["size"] for r in items.listing(ls).collect()} == {"a.bin": 12, "d": -1}


def test_marked(spark):
    assert one(spark.range(1).select(marked(F.array(F.lit(9)), bos=True))) == [2, 9, 3]


def test_event_stream(spark, tmp_path):
    rows = "\n".join(json.dumps({"ts": f"2031-01-01T0{h}:10:00", "event_type": t, "value": v}) for h, t, v in [(1, "a", 1.0), (1, "a", 2.0), (2, "b", 4.0)])
    (tmp_path / "e.json").write_text(rows)
    events = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path))
    rejects.run_once(rejects.event_counts(events), "event_windows")
    got = {(r["event_type"], r["n"], r["total"]) for r in spark.table("event_windows").collect()}
    assert got == {("a", 2, 3.0), ("b", 1, 4.0)}


def test_tokenizer_needs_an_end_token():
    from corpusloom.functions.tokens import Tokenizer, piece_tokenizer

    with pytest.raises(ValueError):
        Tokenizer(stub_ids, 10, None)
    assert piece_tokenizer("/opt/tokenizers/piece_bpe_32k.model").size == 32_000


def test_config():
    config = sinks.read_config('{"batch": 8, "mystery": 1}', {"batch": 1, "max_seq_len": 512})
    assert config == {"batch": 8, "max_seq_len": 512} and sinks.inherit(config, {"d_model": 7, "max_seq_len": 128}) == {"batch": 8, "max_seq_len": 128, "d_model": 7}


def test_compare_reports(spark):
    a, b = (spark.createDataFrame(r, "m string, v double") for r in ([("x", 1.0), ("y", 2.0), ("n", None)], [("x", 2.0), ("y", 2.0), ("z", 1.0)]))
    assert {r["m"]: r["verdict"] for r in compare.compare_reports(a, b, "m", "v").collect()} == {"x": "better", "y": "same", "z": "not measured", "n": "not measured"}


def test_merge_domains(spark):
    merged = lines.merge_domains({"a": spark.createDataFrame([("t", 1)], "text string, n int"), "b": spark.createDataFrame([("u",)], "text string")})
    assert sorted(map(tuple, merged.select("text", "n", "domain").collect())) == [("t", 1, "a"), ("u", None, "b")]
