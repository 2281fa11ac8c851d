"""Plan assertions: the physical plans have the shape the operators promise."""

from pyspark.sql import functions as F

from pressline.plans.registry import QUERIES, load_all

from .conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_visible_pairs_is_an_equi_join(spark):
    load_all()
    p = _plan(QUERIES["visible_pairs"](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_visible_pairs_emits_no_pairs(spark):
    load_all()
    p = _plan(QUERIES["visible_pairs"](spark, SF001))
    assert "posexplode(x" not in p and "k#" not in p and "q#" not in p


def test_offsets_window_is_partitioned_by_bucket(spark):
    from pressline.operators.ordered import prefix_sums

    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("n"))
    p = _plan(prefix_sums(df, "doc_id", {"start": F.col("n")}, bucket_rows=50))
    # the only single-partition exchange is the one over the bucket totals
    assert p.count("SinglePartition") <= 1
    assert "_pb" in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    load_all()
    p = QUERIES["corpus_scan"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in p


def test_encode_has_one_python_node(spark):
    from pressline.operators import bpe

    docs = spark.createDataFrame([(0, "a b"), (1, "b c")], "doc_id long, text string")
    model = bpe.BpeModel.base()
    p = _plan(bpe.bpe_encode(docs, model))
    assert p.count("ArrowEvalPython") == 1


def test_tensor_average_uses_partial_aggregation(spark):
    load_all()
    p = _plan(QUERIES["average_checkpoints"](spark, SF001))
    assert "partial_avg" in p


def test_stages_scan_the_texts_once(spark):
    from pressline.plans.fixtures import stage_corpus

    p = _plan(stage_corpus(spark, SF001))
    assert p.count("documents.parquet") == 1
    for line in p.splitlines():  # lengths only behind the scan
        if "Exchange" in line:
            assert "text" not in line


def test_budget_stop_moves_no_text(spark):
    load_all()
    plan = QUERIES["budget_stop"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert all("text#" not in line for line in plan.splitlines() if "Window" in line or "Join" in line or "Aggregate" in line)


def test_byte_ids_of_null_empty_and_wide_text(spark):
    from pressline.functions.bytes_ import byte_ids, byte_to_id, utf8_bytes

    rows = [(0, None), (1, ""), (2, "aé€"), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    got = {r.k: r for r in df.select("k", byte_ids(F.col("text")).alias("i"), utf8_bytes(F.col("text")).alias("b")).collect()}
    assert got[0].i is None and got[0].b is None and got[1].i == []
    assert got[2].b == list("aé€".encode()) and got[2].i == [byte_to_id()[b] for b in "aé€".encode()]
    assert len(got[3].i) == 100_000
    assert df.where("k < 0").select(byte_ids(F.col("text"))).collect() == []
