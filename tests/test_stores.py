"""Averaging rules, unreadable stores and live reads of a token store."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pressline.operators import bpe
from pressline.operators.tensors import average_checkpoints, round_to_dtype
from pressline.plans import q_sources
from pressline.sources import sinks
from pressline.streaming.packer import _read_state

from .conftest import SF001

TENSORS = "chpt int, key string, dtype string, shape array<int>, values array<double>"


def _avg(spark, rows):
    return {(r.key, r.i): r.value for r in average_checkpoints(spark.createDataFrame(rows, TENSORS)).collect()}


def test_average_rejects_what_does_not_fit(spark):
    ok = [(0, "a", "float32", [2], [1.0, 2.0]), (1, "a", "float32", [2], [3.0, 4.0])]
    assert _avg(spark, ok) == {("a", 0): 2.0, ("a", 1): 3.0}
    for bad in ([(0, "b", "float32", [1], [1.0])], [(0, "b", "float32", [2, 1], [1.0, 1.0]), (1, "b", "float32", [1, 2], [1.0, 1.0])],
                [(0, "n", "int64", [1], [1.0])]):
        with pytest.raises(PySparkException):
            _avg(spark, ok + bad)


def test_average_rounds_to_the_dtype(spark):
    import numpy as np

    values = [1.0002, -3.14159, 65504.0, 70000.0, 6e-8, 1e-9, 0.0, 2049.0, 2051.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(round_to_dtype(F.col("v"), F.lit("float16"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in values]
    got = _avg(spark, [(0, "a", "float16", [1], [1.0]), (1, "a", "float16", [1], [1.0009765625])])
    assert got[("a", 0)] == float(np.float16(1.00048828125))


def test_unreadable_is_not_absent(spark, tmp_path):
    assert _read_state(spark, f"{tmp_path}/none", 5) == (0, None, 0, False)
    assert bpe.load_model(spark, f"{tmp_path}/none", 300, 0) is None
    bad = tmp_path / "state" / "b_0"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        _read_state(spark, f"{tmp_path}/state", 5)
    vocab = tmp_path / "m" / "vocab=300" / "samples=0" / "vocab"
    vocab.mkdir(parents=True)
    (vocab / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        bpe.load_model(spark, f"{tmp_path}/m", 300, 0)


def test_two_token_sources_live(spark):
    a, b = q_sources.token_source(spark, SF001), q_sources.token_source(spark, SF001)
    assert a.count() == b.count() == a.count()


def test_training_reads_the_whole_corpus(spark):
    hist = bpe.word_histogram(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text"))
    plan = hist._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_token_store_rejects_ids_outside_its_vocabulary(spark, tmp_path):
    rows = spark.createDataFrame([("s", "val", 1, 0, 2, [1, 300])], "stage string, split string, doc_id long, pstart long, take long, ids array<int>")
    sinks.write_tokens(rows, f"{tmp_path}/ok", vocab_size=301)
    assert [r["pend"] for r in sinks.read_tokens(spark, f"{tmp_path}/ok", "s", "val", 1).collect()] == [2]
    with pytest.raises(Exception, match="outside uint16 vocabulary of 300"):
        sinks.write_tokens(rows, f"{tmp_path}/bad", vocab_size=300)


def test_checkpoint_versions_sections_and_half_written_saves(spark, tmp_path):
    from pressline.sources.checkpoints import average_to_store, chunked, load_checkpoint, save_checkpoint

    path = f"{tmp_path}/chpt"
    with pytest.raises(FileNotFoundError):
        load_checkpoint(spark, path)
    cols = "section string, key string, dtype string, shape array<int>, values array<double>"
    rows = [("model", "w", "float32", [2, 5], [float(i) for i in range(10)]), ("model", "e", "float32", [0], []), ("optimizer", "m", "float32", [1], [7.0])]
    assert save_checkpoint(chunked(spark.createDataFrame(rows, cols), 4), path) == 1
    back = load_checkpoint(spark, path, ["model"])
    assert {(r.key, r.chunk, tuple(r["values"])) for r in back.collect()} == {
        ("w", 0, (0.0, 1.0, 2.0, 3.0)), ("w", 1, (4.0, 5.0, 6.0, 7.0)), ("w", 2, (8.0, 9.0)), ("e", 0, ())}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "section" in plan.split("PartitionFilters")[1][:80]
    # data of a save that never reached its manifest are not seen
    spark.createDataFrame([("model", "w", 9.0)], "section string, key string, v double").write.partitionBy("section").parquet(f"{path}/data-lost")
    assert load_checkpoint(spark, path).count() == 5
    assert save_checkpoint(chunked(spark.createDataFrame(rows[2:], cols), 4), path) == 2
    assert [r.section for r in load_checkpoint(spark, path).collect()] == ["optimizer"]
    assert load_checkpoint(spark, path, version=1).count() == 5
    with pytest.raises(FileNotFoundError):
        load_checkpoint(spark, path, ["model"])
    average_to_store(spark.createDataFrame([(c, "w", "float32", [3], [c + 1.0, 2.0, 3.0]) for c in (0, 1)], TENSORS), f"{tmp_path}/avg", 2)
    avg = {r.chunk: (r.shape, r["values"]) for r in load_checkpoint(spark, f"{tmp_path}/avg").collect()}
    assert avg == {0: ([3], [1.5, 2.0]), 1: ([3], [3.0])}


def test_results_are_computed_once(spark, tmp_path):
    from pressline.sources.results import ResultStore, request_key

    seen = []

    def score(todo):
        seen.append(sorted(r.q or "" for r in todo.collect()))
        return todo.select("req_key", "task", F.length("q").alias("logprob"))

    rows = [("t1", "a"), ("t1", "bb"), ("t2", "bb"), ("t1", "a"), ("t2", None), ("t2", "")]
    r = spark.createDataFrame(rows, "task string, q string").withColumn("req_key", request_key("task", "q"))
    store = ResultStore(spark, f"{tmp_path}/results")
    assert store.read() is None
    first = store.evaluate(r.where("task = 't1'"), score, 1)
    assert first.count() == 3 and seen == [["a", "bb"]]  # a repeated request is scored once, answered twice
    second = store.evaluate(r, score, 2)
    assert seen[1] == ["", "", "bb"] and second.count() == 6
    assert {(x.task, x.q): (x.run, x.logprob) for x in second.collect()} == {
        ("t1", "a"): (1, 1), ("t1", "bb"): (1, 2), ("t2", "bb"): (2, 2), ("t2", None): (2, None), ("t2", ""): (2, 0)}
    store.upsert(r.where("q = 'a'").distinct().select("req_key", "task", F.lit(99).alias("logprob")), 3)  # the newest run counts
    assert {x.logprob for x in store.split(r)[1].where("q = 'a'").collect()} == {99}
    assert store.split(r.limit(0))[0].count() == 0


def test_bloom_filter_drops_nothing(spark):
    import numpy as np

    from pressline.functions.hashing import Bloom, span_hashes, word_gram_spans

    h = spark.range(3000).select(F.xxhash64("id").alias("h"))
    b = Bloom.of(h, "h", log_bits=16)
    held = np.array([r.h for r in h.collect()])
    assert b.may_hold(held).all()
    assert b.may_hold(np.random.default_rng(0).integers(-2**62, 2**62, 5000)).mean() < 0.05
    raw = np.frombuffer(b"to be or not  to be or not", np.uint8)
    s, e = word_gram_spans(raw, 3)
    grams = [raw[a:z].tobytes().decode() for a, z in zip(s, e)]
    assert grams == [" ".join(w) for w in zip(*[("to be or not  to be or not".split(" "))[i:] for i in range(3)])]
    hashes = span_hashes(raw, s, e)
    assert (len(set(hashes)) == len(set(grams))) and hashes[0] == hashes[grams.index("to be or", 1)]


def test_holdout_check_equals_brute_force(spark):
    import random

    from pressline.operators.posttrain import holdout_check, holdout_clean

    rnd = random.Random(4)
    w = lambda n: " ".join(rnd.choice(["a", "b", "cc", "ä", ""]) for _ in range(n))
    docs = [(i, w(rnd.randint(0, 40)), "x") for i in range(80)] + [(None, "a b cc", "x"), (99, None, "x"), (5, "x " * 500, "y")]
    bench = [(w(6),) for _ in range(6)] + [(None,), ("",)]
    grams = lambda t: [tuple((t or "").split(" ")[i:i + 4]) for i in range(len((t or "").split(" ")) - 3)]
    held = {g for (t,) in bench for g in grams(t)}
    want = {}
    for d, t, _ in docs:
        if n := sum(g in held for g in grams(t)):
            want[d] = want.get(d, 0) + n
    df, bf = spark.createDataFrame(docs, "doc_id long, text string, matched_ngrams string"), spark.createDataFrame(bench, "text string")
    assert {r.doc_id: r.matched_ngrams for r in holdout_check(df, bf, 4).collect()} == want and want
    assert sorted((r.doc_id or -1) for r in holdout_clean(df, bf, 4).collect()) == sorted((d or -1) for d, _, _ in docs if d not in want)
    plan = holdout_check(df, bf, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan


def test_blocks_of_a_range_read_their_pieces_only(spark, tmp_path):
    from pressline.operators import packing as K

    rows, at = [], 0
    for i in range(300):
        n = 3 + i % 7
        rows.append(("s", "train", i, at, n, [at + k for k in range(n)]))
        at += n
    p = spark.createDataFrame(rows, "stage string, split string, doc_id long, pstart long, take long, ids array<int>")
    sinks.write_tokens(p, f"{tmp_path}/store")
    L = 16
    whole = {r.block_idx: r.tokens for r in K.make_blocks(p, L).collect()}
    for first, last in ((0, 0), (5, 9), (max(whole), max(whole) + 3)):
        got = sinks.read_blocks(spark, f"{tmp_path}/store", "s", "train", L, first, last)
        assert {r.block_idx: r.tokens for r in got.collect()} == {b: t for b, t in whole.items() if first <= b <= last}
        used = K.wanted_pieces(p, L, first, last).collect()
        assert len(used) <= (last - first + 1) * L / 3 + 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pend," in plan and "LessThan(pstart," in plan
