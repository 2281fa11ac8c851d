"""Inputs derived from the driver tables (FIXTURES.md section 2), each as a
Spark DataFrame and as the matching DuckDB SQL common-table expression.

All derivations are plain projections, filters, semi-joins and aggregates,
so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.fixed import STAGES
from pressline.operators.ordered import row_index
from pressline.operators.packing import byte_doc_len
from pressline.session import materialize, materialize_table
from pressline.sources.tables import table

# per-stage sequence length used by the packing fixtures (overfit profile)
STAGE_SEQ_LEN = {"initial_stage": 128, "lc_stage": 512, "annealing_stage": 1024}
LC_MIN_CHARS = 4000
TOKENS_PER_STEP = 256


# ------------------------------------------------------------------ documents


def stage_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """initial = all documents; lc = long documents; annealing = documents
    labelled high quality. One scan of the texts: a document's length is taken
    in the scan and its row repeated for the stages it belongs to."""
    return stage_rows(spark, sf, table(spark, sf, "documents").select("doc_id", "n_chars", byte_doc_len(F.col("text")).alias("n")))


def stage_rows(spark: SparkSession, sf: str, lengths: DataFrame) -> DataFrame:
    """(stage, doc_id, n) from one (doc_id, n_chars, n) row per document."""
    good = table(spark, sf, "labels").filter(F.col("quality") == 1).select("doc_id").distinct().withColumn("_good", F.lit(True))
    stages = F.array_compact(F.array(
        F.lit("initial_stage"),
        F.when(F.col("n_chars") >= LC_MIN_CHARS, F.lit("lc_stage")),
        F.when(F.col("_good"), F.lit("annealing_stage"))))
    return lengths.join(good, "doc_id", "left").select(F.explode(stages).alias("stage"), "doc_id", "n")


def stage_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """(stage, doc_id, n) written as a small table: budgets, offsets and the
    split all derive from it instead of re-reading the texts."""
    return materialize_table(stage_corpus(spark, sf), "stage-lengths")


def stage_cfg(corpus: DataFrame) -> DataFrame:
    """Budgets per stage: V = floor(0.02 * sum n), T = floor(0.6 * sum n)."""
    seq = F.create_map(*[x for s in STAGES for x in (F.lit(s), F.lit(STAGE_SEQ_LEN[s]))])
    return corpus.groupBy("stage").agg(F.sum("n").alias("_tot")).select(
        "stage",
        F.expr("(_tot * 2) div 100").cast("long").alias("val_target"),
        F.expr("(_tot * 6) div 10").cast("long").alias("train_target"),
        F.element_at(seq, F.col("stage")).alias("seq_len"),
    )


def sql_stage(docs: str = "documents", n: str = "CAST(octet_length(encode(text)) + 2 AS BIGINT)") -> str:
    """Stages, budgets, offsets, split and pieces over a relation of documents whose length is ``n``."""
    return f"""
stage_corpus AS (
  SELECT 'initial_stage' AS stage, doc_id, {n} AS n, text FROM {docs}
  UNION ALL
  SELECT 'lc_stage', doc_id, {n}, text FROM {docs} WHERE n_chars >= {LC_MIN_CHARS}
  UNION ALL
  SELECT 'annealing_stage', doc_id, {n}, text FROM {docs}
   WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
),
stage_cfg AS (
  SELECT stage, CAST((sum(n) * 2) // 100 AS BIGINT) AS val_target,
         CAST((sum(n) * 6) // 10 AS BIGINT) AS train_target,
         CASE stage WHEN 'initial_stage' THEN {STAGE_SEQ_LEN['initial_stage']}
                    WHEN 'lc_stage' THEN {STAGE_SEQ_LEN['lc_stage']}
                    ELSE {STAGE_SEQ_LEN['annealing_stage']} END AS seq_len
  FROM stage_corpus GROUP BY stage
),
offsets AS (
  SELECT c.stage, c.doc_id, c.n, c.text,
         CAST(coalesce(sum(c.n) OVER (PARTITION BY c.stage ORDER BY c.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM stage_corpus c
),
bnd AS (
  SELECT o.stage, min(o.start + o.n) AS vend FROM offsets o JOIN stage_cfg g USING (stage)
  WHERE g.val_target > 0 AND o.start + o.n >= g.val_target GROUP BY o.stage
),
split AS (
  SELECT o.stage, o.doc_id, o.n, o.start, o.text, g.seq_len,
    CAST(CASE WHEN g.val_target > 0 THEN greatest(0, least(o.n, g.val_target - o.start)) ELSE 0 END AS BIGINT) AS val_take,
    CAST(CASE WHEN (CASE WHEN g.val_target = 0 THEN 0 ELSE b.vend END) IS NOT NULL
               AND o.start >= (CASE WHEN g.val_target = 0 THEN 0 ELSE b.vend END)
         THEN greatest(0, least(o.n, g.train_target - (o.start - (CASE WHEN g.val_target = 0 THEN 0 ELSE b.vend END))))
         ELSE 0 END AS BIGINT) AS train_take,
    CAST(o.start - (CASE WHEN g.val_target = 0 THEN 0 ELSE b.vend END) AS BIGINT) AS tstart,
    CAST(CASE WHEN g.val_target > 0 AND o.start + o.n = b.vend
              AND greatest(0, least(o.n, g.val_target - o.start)) < o.n
         THEN o.n - greatest(0, least(o.n, g.val_target - o.start)) ELSE 0 END AS BIGINT) AS lost
  FROM offsets o JOIN stage_cfg g USING (stage) LEFT JOIN bnd b USING (stage)
),
pieces AS (
  SELECT stage, 'val' AS split, doc_id, n, text, seq_len, start AS pstart, val_take AS take FROM split WHERE val_take > 0
  UNION ALL
  SELECT stage, 'train', doc_id, n, text, seq_len, tstart, train_take FROM split WHERE train_take > 0
)"""


SQL_STAGE = sql_stage()


# ------------------------------------------------------------------ run log


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """run = event_type; step = position within the run by event_id (dense,
    1-based, distributed); loss = value; n = rows in the run; stage by
    ``10*step <= 6n`` / ``<= 9n`` / else; tokens_processed = 256 * step."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), "event_id", "ts", F.col("value").alias("loss"))
    ev = row_index(ev, "event_id", "step", by=["run"])
    n = ev.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    ev = ev.join(n, "run")
    stage = (F.when(F.col("step") * 10 <= F.col("n") * 6, F.lit("initial_stage"))
             .when(F.col("step") * 10 <= F.col("n") * 9, F.lit("lc_stage"))
             .otherwise(F.lit("annealing_stage")))
    return materialize(ev.select("run", "step", "event_id", "ts", "loss", "n", stage.alias("stage"),
                                 (F.col("step") * TOKENS_PER_STEP).alias("tokens_processed")))


SQL_RUN_LOG = f"""
rl0 AS (
  SELECT event_type AS run, event_id, ts, value AS loss,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events
),
run_log AS (
  SELECT run, CAST(step AS BIGINT) AS step, event_id, ts, loss, CAST(n AS BIGINT) AS n,
    CASE WHEN step * 10 <= n * 6 THEN 'initial_stage' WHEN step * 10 <= n * 9 THEN 'lc_stage'
         ELSE 'annealing_stage' END AS stage,
    CAST(step * {TOKENS_PER_STEP} AS BIGINT) AS tokens_processed
  FROM rl0
)"""


def val_log(spark: SparkSession, sf: str) -> DataFrame:
    rl = run_log(spark, sf)
    return rl.filter(F.col("step") % 200 == 0).select("run", "step", (F.col("loss") * 1.1).alias("loss"))


SQL_VAL_LOG = """
val_log AS (SELECT run, step, loss * 1.1 AS loss FROM run_log WHERE step % 200 = 0)"""


# ------------------------------------------------------------------ logits and tensors


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """doc = vec_id div 8, pos = vec_id mod 8, logits = embedding as DOUBLE,
    target = label (0 = pad)."""
    e = table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 8").alias("doc"), F.expr("vec_id % 8").alias("pos"),
                    F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").alias("target"))


SQL_LOGITS = """
logits_t AS (
  SELECT vec_id // 8 AS doc, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS logits, label AS target
  FROM embeddings
)"""


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    """chpt = vec_id div 100, key = 'w' || (vec_id mod 100); dtype int64 when
    key number mod 10 = 0 (values floored) else float32; shape [64]."""
    e = table(spark, sf, "embeddings")
    k = F.expr("vec_id % 100")
    is_int = (k % 10) == 0
    vals = F.when(is_int, F.transform(F.col("embedding"), lambda v: F.floor(v).cast("double"))) \
        .otherwise(F.col("embedding").cast("array<double>"))
    return e.select(F.expr("vec_id div 100").alias("chpt"),
                    F.concat(F.lit("w"), k.cast("string")).alias("key"),
                    F.when(is_int, F.lit("int64")).otherwise(F.lit("float32")).alias("dtype"),
                    F.array(F.size("embedding")).alias("shape"), vals.alias("values"))


SQL_TENSORS = """
tensors AS (
  SELECT vec_id // 100 AS chpt, 'w' || CAST(vec_id % 100 AS VARCHAR) AS key,
         CASE WHEN vec_id % 10 = 0 THEN 'int64' ELSE 'float32' END AS dtype,
         [len(embedding)] AS shape,
         CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda v: CAST(floor(v) AS DOUBLE))
              ELSE CAST(embedding AS DOUBLE[]) END AS vals
  FROM embeddings
)"""


# ------------------------------------------------------------------ evaluation requests


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """query = first half of a benchmark text, choice = the rest; task by
    item parity; stop strings fixed."""
    b = table(spark, sf, "benchmark")
    half = (F.char_length("text") / 2).cast("int")
    return b.select(F.col("item_id").alias("item"),
                    F.when(F.col("item_id") % 2 == 0, F.lit("gsm8k")).otherwise(F.lit("math")).alias("task"),
                    F.substring(F.col("text"), F.lit(1), half).alias("query"),
                    F.expr("substr(text, cast(char_length(text) / 2 as int) + 1)").alias("choice"),
                    F.array(F.lit(" the "), F.lit(". ")).alias("stops"))


SQL_REQUESTS = """
requests AS (
  SELECT item_id AS item, CASE WHEN item_id % 2 = 0 THEN 'gsm8k' ELSE 'math' END AS task,
         substr(text, 1, CAST(trunc(length(text) / 2) AS INTEGER)) AS query,
         substr(text, CAST(trunc(length(text) / 2) AS INTEGER) + 1) AS choice,
         [' the ', '. '] AS stops
  FROM benchmark
)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("prompt"), F.col("doc_id").alias("response"),
                    (F.col("n_chars") % 997).alias("score"))


SQL_CANDIDATES = """
candidates AS (SELECT source AS prompt, doc_id AS response, n_chars % 997 AS score FROM documents)"""
