"""Registered queries: Structured Streaming variants.

The packer replays the documents by key ranges, its result is the batch split
(K2) with the same budgets, so its oracle is the batch SQL. The monitor reads
the run log as it was appended, file by file (``availableNow``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators.packing import byte_doc_len
from pressline.plans.q_runlog import ETA_TARGETS
from pressline.plans.q_schedule import SQL_MICRO, micro_log
from pressline.plans.q_text import LIBRARY
from pressline.plans.q_trained import _tokens
from pressline.plans.registry import register, with_ctes
from pressline.session import scratch_path
from pressline.sources.tables import table
from pressline.streaming import monitor, packer
from pressline.streaming.ranges import key_cuts

VAL_SHARE, TRAIN_SHARE = 50, 5   # budgets: a fiftieth and a fifth of the corpus tokens
RANGE_DOCS = 50_000              # documents of a micro-batch, about; eight batches at least

SQL_STREAM_SPLIT = f"""
WITH bud AS (SELECT sum(octet_length(encode(text)) + 2)::BIGINT // {VAL_SHARE} AS v, sum(octet_length(encode(text)) + 2)::BIGINT // {TRAIN_SHARE} AS t FROM documents),
c AS (SELECT doc_id, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS n FROM documents),
o AS (SELECT doc_id, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c),
b AS (SELECT min(start + n) AS vend FROM o WHERE start + n >= (SELECT v FROM bud)),
s AS (
  SELECT o.doc_id, o.n, o.start,
         CAST(greatest(0, least(o.n, bud.v - o.start)) AS BIGINT) AS val_take,
         CAST(CASE WHEN b.vend IS NOT NULL AND o.start >= b.vend THEN greatest(0, least(o.n, bud.t - (o.start - b.vend))) ELSE 0 END AS BIGINT) AS train_take,
         CAST(CASE WHEN o.start + o.n = b.vend AND greatest(0, least(o.n, bud.v - o.start)) < o.n
                   THEN o.n - greatest(0, least(o.n, bud.v - o.start)) ELSE 0 END AS BIGINT) AS lost
  FROM o, b, bud
)
SELECT doc_id, n, start, val_take, train_take, lost FROM s WHERE val_take > 0 OR train_take > 0 OR lost > 0"""


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", byte_doc_len(F.col("text")).cast("long").alias("n"))


def _plan(lengths: DataFrame) -> tuple[int, int, int]:
    """Budgets and the number of ranges."""
    total, docs = lengths.agg(F.sum("n"), F.count(F.lit(1))).first()
    return (total or 0) // VAL_SHARE, (total or 0) // TRAIN_SHARE, max(8, docs // RANGE_DOCS)


def _result(spark: SparkSession, out: str) -> DataFrame:
    r = spark.read.parquet(out)
    return r.filter((F.col("val_take") > 0) | (F.col("train_take") > 0) | (F.col("lost") > 0)).select(
        "doc_id", "n", "start", "val_take", "train_take", "lost")


@register("stream_pack", sql=SQL_STREAM_SPLIT)
def stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental split of the document stream, a key range per micro-batch."""
    n = _lengths(spark, sf)
    return _result(spark, packer.run_stream_pack(spark, n, *_plan(n))[0])


@register("stream_pack_trained", rows_only=LIBRARY)
def stream_pack_trained(spark: SparkSession, sf: str) -> DataFrame:
    """X1 over trained ids: the same stream, lengths from the token table."""
    n = _tokens(spark, sf).select("doc_id", "n")
    return _result(spark, packer.run_stream_pack(spark, n, *_plan(n))[0])


@register("stream_take", sql=SQL_STREAM_SPLIT.rsplit("SELECT doc_id, n, start", 1)[0] + """
SELECT (SELECT vend FROM b) AS vend, CAST(sum(train_take) AS BIGINT) AS train_written,
       sum(train_take) >= (SELECT t FROM bud) AS done FROM s""")
def stream_take(spark: SparkSession, sf: str) -> DataFrame:
    """The stream ends once the budgets are met. The carried state at the end."""
    n = _lengths(spark, sf)
    _, state, _ = packer.run_stream_pack(spark, n, *_plan(n))
    last = F.max_by(F.struct("vend", "train_written", "done"), "batch_id").alias("s")
    return packer.stream_state(spark, state).agg(last).select("s.vend", "s.train_written", "s.done")


@register("stream_resume", sql=SQL_STREAM_SPLIT)
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The packer runs over the first ranges and stops; a new run on the
    same checkpoint and state goes on behind them without re-reading. The final
    output equals one uninterrupted run."""
    n = _lengths(spark, sf)
    v, t, ranges = _plan(n)
    cuts = key_cuts(n, "doc_id", ranges)
    out, _, work = packer.run_stream_pack(spark, n, v, t, ranges, cuts=cuts, end=ranges // 8)
    packer.run_stream_pack(spark, n, v, t, ranges, cuts=cuts, work=work)
    return _result(spark, out)


@register("stream_run_monitor", sql="WITH RECURSIVE " + with_ctes(SQL_MICRO, """
iv AS (SELECT run, step, loss, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step))) / 1e6, 0) AS sec FROM microA),
e(run, step, ema, avg) AS (
  SELECT run, step, loss, sec FROM iv WHERE step = 1
  UNION ALL
  SELECT i.run, i.step, 0.1 * i.loss + 0.9 * e.ema, 0.1 * i.sec + 0.9 * e.avg FROM e JOIN iv i ON i.run = e.run AND i.step = e.step + 1
),
eta0 AS (
  SELECT run, step, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run, stage))) / 1e6 AS elapsed,
         CASE WHEN stage = 'initial_stage' THEN stage_step ELSE stage_tokens END AS done,
         CASE stage WHEN 'initial_stage' THEN 1000 WHEN 'lc_stage' THEN 100000 ELSE 50000 END AS target
  FROM microA)""", body="""
SELECT run, step, round(e.ema, 6) AS ema, round(e.avg, 3) AS avg_time, round(elapsed, 6) AS elapsed_sec,
       CASE WHEN elapsed > 0 THEN round(done / elapsed, 6) END AS rate,
       CAST(CASE WHEN done = 0 OR elapsed <= 0 THEN 0 ELSE floor(greatest((target - done) / (done / elapsed), 0.0)) END AS BIGINT) AS eta_sec
FROM e JOIN eta0 USING (run, step)""").removeprefix("WITH "))
def stream_run_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Loss average, seconds per update, rate and ETA of every update of
    the log stream (state per run)."""
    src, work = (scratch_path(spark, f"stream-{x}-{uuid.uuid4().hex[:12]}") for x in ("log", "mon"))
    log = micro_log(spark, sf).withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    names = [x.split()[0] for x in monitor.LOG_SCHEMA.split(", ")]
    log.select(*names).repartitionByRange(8, "step", "run").sortWithinPartitions("step").write.parquet(src)
    run_to_end(monitor.run_monitor(spark.readStream.schema(monitor.LOG_SCHEMA).option("maxFilesPerTrigger", 2).parquet(src), ETA_TARGETS), work)
    r = spark.read.parquet(f"{work}/out")
    return r.select("run", "step", F.round("avg_time", 3).alias("avg_time"),
                    *[F.round(c, 6).alias(c) for c in ("ema", "elapsed_sec", "rate")], "eta_sec")


def run_to_end(stream: DataFrame, work: str) -> None:
    """Runs a stream over all that is there now, its state in RocksDB."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    was = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/ckpt")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    finally:
        conf.set(name, was)
