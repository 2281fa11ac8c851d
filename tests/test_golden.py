"""Golden examples (FIXTURES.md section 3): values derived from the reference's
formulas and worked examples."""

import math

from pyspark.sql import functions as F

from pressline.functions.bytes_ import byte_to_char, byte_to_id
from pressline.functions.fixed import PROFILES
from pressline.operators import packing as K
from pressline.operators import schedule as C


def test_visibility_segments(spark):
    block = [1] * 4 + [2] + [1] * 9 + [2] + [1] * 8 + [2]
    df = spark.createDataFrame([(0, block)], "block_idx long, x array<int>")
    seg = df.select(K.doc_segments(F.col("x")).alias("s")).first()["s"]
    assert seg == [0] * 5 + [1] * 10 + [2] * 9
    rows = K.block_token_rows(df, "x")
    pairs = {(r["q"], r["k"]) for r in K.visible_pairs(rows).collect()}
    assert (0, 10) not in pairs and (10, 1) not in pairs and (10, 6) in pairs
    assert len(pairs) == 15 + 55 + 45
    cost = K.mask_cost(df, "x").first()
    assert (cost["visible_pairs"], cost["causal_pairs"], cost["segments"]) == (115, 300, 3)


def test_packing_example_without_bod(spark):
    docs = [(0, [512, 1024, 850]), (1, [10, 440, 990]), (2, [88, 310, 500])]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    df = df.withColumn("ids", K.add_markers(F.col("ids"), bod=False)).withColumn("n", F.size("ids").cast("long"))
    df = df.withColumn("stage", F.lit("s"))
    off = K.token_offsets(df).withColumnRenamed("start", "pstart").withColumn("split", F.lit("train"))
    flat = [r["id"] for r in K.flat_stream(off).orderBy("pos").collect()]
    assert flat == [512, 1024, 850, 2, 10, 440, 990, 2, 88, 310, 500, 2]


def test_blocks_and_resume(spark):
    p = spark.createDataFrame([("s", "train", 0, 26, list(range(26)))],
                              "stage string, split string, pstart long, take long, ids array<int>")
    b = {r["block_idx"]: r for r in K.make_blocks(p, 8).collect()}
    assert sorted(b) == [0, 1, 2]
    assert b[0]["x"] == list(range(8)) and b[0]["y"] == list(range(1, 9))
    assert b[2]["x"] == list(range(16, 24)) and b[2]["y"] == list(range(17, 25))
    expected = {0: [0, 1, 2, 0, 1], 6: [0, 1, 2, 0, 1], 8: [1, 2, 0, 1, 2], 16: [2, 0, 1, 2, 0], 24: [0, 1, 2, 0, 1]}
    for seen, idx in expected.items():
        blocks = spark.range(3).withColumnRenamed("id", "block_idx")
        w = K.epoch_wrap(blocks, F.lit(3).cast("long"), 2, seen, 8).orderBy("fetch_i").collect()
        assert [r["block_idx"] for r in w] == idx + idx[2:3]
        assert [r["fetch_i"] for r in w] == list(range(6))
        assert [r["fetch_i"] for r in w if r["epoch_mark"]] == [i for i in range(1, 6) if w[i]["block_idx"] == 0]


def test_split_quirk(spark):
    docs = spark.createDataFrame([("s", i, 5) for i in range(4)], "stage string, doc_id long, n long")
    cfg = spark.createDataFrame([("s", 7, 6)], "stage string, val_target long, train_target long")
    r = K.split_by_budget(K.token_offsets(docs), cfg).orderBy("doc_id").collect()
    assert [x["val_take"] for x in r] == [5, 2, 0, 0]
    assert [x["lost"] for x in r] == [0, 3, 0, 0]
    assert [x["train_take"] for x in r] == [0, 0, 5, 1]


def _lr(spark, p, steps):
    df = spark.createDataFrame([(s,) for s in steps], "s long")
    e = C.lr_warmup_cosine(F.col("s"), p["warmup_steps"], p["steps"], p["peak_lr"], p["decay_lr_to"])
    return [r[0] for r in df.select(e).collect()]


def test_learning_rate(spark):
    full, scaled = PROFILES["full"], PROFILES["scaled"]
    got = _lr(spark, full, [0, 1, 4000, 8000, 600000, 1199999, 1200000])
    want = [0, 1e-08, 4e-05, 8e-05, 4.0817465653282554e-05, 8.000000001375351e-07, 8e-07]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-20) for a, b in zip(got, want))
    got = _lr(spark, scaled, [250, 500, 5761, 6011, 11521, 11522])
    want = [5e-05, 1e-04, 5.393137273509081e-05, 5.04e-05, 8.000020147938194e-07, 8e-07]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want))
    df = spark.createDataFrame([(0,), (12_000_000,), (24_000_000,)], "t long")
    got = [r[0] for r in df.select(C.lr_linear_anneal(F.col("t"), 24_000_000, 8e-7, 0.0)).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-20) for a, b in zip(got, [8e-07, 4e-07, 0.0]))


def test_seq_len_milestones(spark):
    df = spark.range(1)
    got = df.select(C.seqlen_milestones(8192, 128000).alias("a"), C.seqlen_milestones(4096, 8192).alias("b"),
                    C.seqlen_milestones(512, 1024).alias("c")).first()
    assert got["a"] == [8192, 32154, 56115, 80077, 104038, 128000]
    assert got["b"] == [4096, 4915, 5734, 6554, 7373, 8192]
    assert got["c"] == [512, 614, 717, 819, 922, 1024]
    t = spark.createDataFrame([(81_666_666,), (81_666_667,), (490_000_000,)], "t long")
    assert [r[0] for r in t.select(C.longctx_index(F.col("t"), 490_000_000)).collect()] == [0, 1, 5]


def test_accumulation_steps(spark):
    df = spark.createDataFrame([(250000, 2, 2048), (500000, 2, 4096), (256, 2, 128), (1024, 2, 614)],
                               "g long, m int, l int")
    assert [r[0] for r in df.select(C.accum_steps(F.col("g"), F.col("m"), F.col("l"))).collect()] == [62, 62, 1, 1]


def test_smoothing_window(spark):
    from pressline.operators.runlog import moving_average

    log = spark.range(1, 1001).select(F.lit("r").alias("run"), F.col("id").alias("step"),
                                      (F.col("id") * 1.0).alias("loss"))
    out = moving_average(log).orderBy("step").collect()
    assert len(out) == 901 and out[0]["step"] == 50 and out[0]["smoothed"] == sum(range(1, 101)) / 100


def test_tokenizer_alphabet():
    chars, ids = byte_to_char(), byte_to_id()
    by_id = {ids[b]: chars[b] for b in range(256)}
    assert by_id[4] == "!" and by_id[259] == "Ń"
    assert sorted(ids) == list(range(4, 260))


def test_special_audit_rows(spark):
    from pressline.functions.text import has_special, pretokenize_with_specials

    rows = ["a <|end_of_doc|> b", "<|unk|>", "<| end_of_doc |>", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    flags = [r[0] for r in df.select(has_special(F.col("t"))).collect()]
    assert flags == [True, True, False, False]
    words = df.select(pretokenize_with_specials(F.col("t"))).first()[0]
    assert words == ["a", " ", "<|end_of_doc|>", " b"]
