"""What large tables asked for: half-saved checkpoints, sums beyond 64 bits,
blocks without a shuffle of the ids, words encoded by batches."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pressline.functions.fixed import BOD_ID, EOD_ID
from pressline.functions.text import pretokenize_with_specials
from pressline.operators import bpe
from pressline.operators import packing as K
from pressline.operators.tensors import average_checkpoints
from pressline.plans import q_packing

from .test_stores import TENSORS


def test_average_over_the_checkpoints_that_hold_a_key(spark):
    rows = [(0, "a", "float32", [2], [1.0, 2.0]), (1, "a", "float32", [2], [3.0, 4.0]), (0, "b", "float32", [1], [7.0]),
            (1, "n", "int64", [1], [5.0])]
    got = {(r.key, r.i): r.value for r in average_checkpoints(spark.createDataFrame(rows, TENSORS), every=False).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): 7.0, ("n", 0): 5.0}
    for bad in ([(1, "b", "float32", [2, 1], [1.0, 1.0])], [(0, "b", "float32", [1], [8.0])]):  # another shape, a key twice
        with pytest.raises(PySparkException):
            average_checkpoints(spark.createDataFrame(rows + bad, TENSORS), every=False).collect()


def test_weighted_positions_beyond_64_bits(spark, monkeypatch):
    far = 1 << 33  # 4e9 ids of 200 at such positions and beyond
    rows = [("s", "train", far, [250] * 1000)] * 5000
    pieces = spark.createDataFrame(rows, "stage string, split string, pstart long, ids array<int>")
    corpus = spark.createDataFrame([("initial_stage", far)], "stage string, n long")
    monkeypatch.setattr(q_packing, "stage_lengths", lambda *_: corpus)
    monkeypatch.setattr(q_packing, "_pieces", lambda *_: pieces)
    r = q_packing.flat_stream(spark, "").first()
    assert int(r.pos_weighted) == 5000 * 250 * sum(range(far, far + 1000)) > 1 << 63


def test_blocks_of_texts_are_those_of_their_ids(spark):
    texts = ["", "ab", "x" * 40, "é世", "word " * 9]
    at, rows = 0, []
    for i, t in enumerate(texts):
        n = len(t.encode()) + 2
        rows.append(("s", "train", i, at, n - (i == 4), t))  # the last one is cut
        at += n - (i == 4)
    p = spark.createDataFrame(rows, "stage string, split string, doc_id long, pstart long, take long, ids string")
    lists = p.withColumn("ids", F.slice(K.byte_doc_ids(F.col("ids")), 1, F.col("take").cast("int")))
    flat = [r.id for r in K.flat_stream(lists).orderBy("pos").collect()]
    assert len(flat) == at and flat[:2] == [BOD_ID, EOD_ID]
    assert sorted(map(str, K.cut_to_take(p).select("doc_id", "ids").collect())) == sorted(map(str, lists.select("doc_id", "ids").collect()))
    for L in (1, 7, 16):
        want = {b: flat[b * L:b * L + L + 1] for b in range((at - 1) // L)}
        for pieces in (p, lists):
            assert {r.block_idx: r.tokens for r in K.make_blocks(pieces, L).collect()} == want


def test_shared_positions_give_one_block(spark):
    rows = [("s", "train", 0, 6, [1, 2, 3, 4, 5, 6], None), ("s", "train", 6, 7, [7] * 7, 6), ("s", "train", 6, 7, [8] * 7, 6)]
    p = spark.createDataFrame(rows, "stage string, split string, pstart long, take long, ids array<int>, _alone long")
    lens = spark.createDataFrame([("s", "train", 13)], "stage string, split string, stream_len long")
    got = sorted((r.block_idx, r.tokens) for r in K.make_blocks(p, 3, lens=lens, alone="_alone").collect())
    assert got == [(0, [1, 2, 3, 4]), (1, [4, 5, 6, 7, 8]), (2, [7] * 4 + [8] * 4), (3, [7] * 4 + [8] * 4)]


def test_no_shuffle_of_ids_by_stream(spark):
    p = spark.createDataFrame([("s", "train", 0, 3, [1, 4, 2])], "stage string, split string, pstart long, take long, ids array<int>")
    plan = K.make_blocks(p, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_ids_are_dealt_by_their_size(spark):
    p = spark.createDataFrame([(i, "s", "train", 4, 3 * i, 3) for i in range(50)], "doc_id long, stage string, split string, seq_len int, pstart long, take long")
    ids = spark.createDataFrame([(i, [1, 4, 2]) for i in range(50)], "doc_id long, ids array<int>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # pieces too many to be broadcast
    try:
        both = q_packing._with_ids(p, ids, 40 * K.TASK_BYTES)
        assert both.rdd.getNumPartitions() == 40 and both.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_segments_of_many_blocks(spark):
    blocks = [[5, 2, 6, 7], [2, 2, 9], [], None, [4], [8, 2]]
    df = spark.createDataFrame(list(enumerate(blocks)), "i int, x array<int>").coalesce(1)
    got = df.select("i", K.doc_segments(F.col("x")).alias("s"), K.segment_lengths(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.s for r in got] == [[0, 0, 1, 1], [0, 1, 2], [], [], [0], [0, 0]]
    assert [r.n for r in got] == [[2, 2], [1, 1, 1], [], None, [1], [2]]


def test_pretokens_with_and_without_specials(spark):
    df = spark.createDataFrame([(0, "a b<|unk|> c"), (1, "a b c"), (2, ""), (3, None)], "i int, t string")
    got = [r.w for r in df.select("i", pretokenize_with_specials(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [["a", " b", "<|unk|>", " c"], ["a", " b", " c"], [], None]
    model = bpe.BpeModel.base()
    ids = {r.i: r.ids for r in bpe.bpe_encode(df, model, key="i", text="t").collect()}
    assert ids[2] == ids[3] == [BOD_ID, EOD_ID] and len(ids[0]) == 2 + 6 and len(ids[1]) == 7
