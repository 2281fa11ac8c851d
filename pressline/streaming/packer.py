"""Incremental split/pack over a document stream.

A stream of key ranges (``ranges``) -> ``foreachBatch``: each micro-batch reads
its documents, computes their stream offsets (distributed prefix sums) on top
of the tokens carried from earlier batches, then the closed-form budget split
(K2). The carried state is a small table keyed by batch id in the shared
checkpoint folder, so a re-run of a batch (after a failure) reads the same
inputs and overwrites the same output partition: the sink is idempotent. The
query's own ``checkpointLocation`` makes a restart continue where it stopped
(X4). The last range to read is known from the ranges' token totals: the source
ends there, and so does the query (X2).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators.ordered import prefix_sums
from pressline.session import scratch_path
from pressline.streaming.ranges import key_cuts, range_number, range_stream, rows_of

STATE_SCHEMA = "batch_id long, total long, vend long, train_written long, done boolean"


def _read_state(spark: SparkSession, state_path: str, batch_id: int):
    try:
        st = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/*").filter(F.col("batch_id") < batch_id)
        row = st.orderBy(F.col("batch_id").desc()).limit(1).collect()
    except AnalysisException as e:  # no state yet; any other storage error must stop the stream
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = []
    if not row:
        return 0, None, 0, False
    r = row[0]
    return r["total"], r["vend"], r["train_written"], bool(r["done"])


def last_range(lengths: DataFrame, key: str, cuts: list[int], V: int, T: int) -> int:
    """How many ranges hold the budgets: training starts at the latest one
    document behind V, so the ranges up to V + T and the longest document."""
    sums = lengths.groupBy(range_number(key, cuts).alias("i")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    need, total = V + T + max([0, *(r["most"] or 0 for r in sums)]), 0
    for r in sorted(sums, key=lambda r: r["i"]):
        total += r["n"] or 0
        if total >= need:
            return r["i"] + 1
    return len(cuts) + 1


def make_batch_fn(lengths: DataFrame, key: str, out_path: str, state_path: str, V: int, T: int):
    """The ``foreachBatch`` body over (key, n) rows with val/train budgets V and T."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        total, vend, train_written, done = _read_state(spark, state_path, batch_id)
        if done:  # the budgets were met by an earlier batch
            return
        (r,) = batch.collect()
        d = rows_of(lengths, key, r["lo"], r["hi"]).select(F.col(key).alias("doc_id"), "n")
        d = prefix_sums(d, "doc_id", {"start": F.col("n")}).withColumn("start", F.col("start") + F.lit(total))
        d = d.persist()
        agg = d.agg(F.sum("n").alias("s"),
                    F.min(F.when((F.lit(V) > 0) & (F.col("start") + F.col("n") >= V), F.col("start") + F.col("n")))
                    .alias("bend")).first()
        new_total = total + (agg["s"] or 0)
        if vend is None:
            vend = 0 if V == 0 else agg["bend"]
        end = F.col("start") + F.col("n")
        val_take = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(V) - F.col("start"))) if V > 0 else F.lit(0)
        if vend is None:
            train_take = F.lit(0)
        else:
            tstart = F.col("start") - F.lit(vend)
            train_take = F.when(F.col("start") >= vend,
                                F.greatest(F.lit(0), F.least(F.col("n"), F.lit(T) - tstart))).otherwise(F.lit(0))
        lost = (F.when(F.lit(vend is not None) & (end == F.lit(vend if vend is not None else -1))
                       & (val_take < F.col("n")), F.col("n") - val_take).otherwise(F.lit(0)))
        res = d.select("doc_id", "n", "start", val_take.cast("long").alias("val_take"),
                       train_take.cast("long").alias("train_take"), lost.cast("long").alias("lost"),
                       F.lit(batch_id).cast("long").alias("batch_id"))
        (res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))
        written = spark.read.parquet(out_path).filter(F.col("batch_id") == batch_id) \
            .agg(F.sum("train_take")).first()[0] or 0
        train_written += written
        now_done = vend is not None and train_written >= T
        spark.createDataFrame([(batch_id, new_total, vend, train_written, now_done)], STATE_SCHEMA) \
            .write.mode("overwrite").parquet(f"{state_path}/b_{batch_id}")
        d.unpersist()

    return run


def run_stream_pack(spark: SparkSession, lengths: DataFrame, V: int, T: int, ranges: int, key: str = "doc_id",
                    work: str | None = None, cuts: list[int] | None = None, end: int | None = None) -> tuple[str, str, str]:
    """Split the documents of ``lengths`` (key, n: tokens), about ``ranges``
    micro-batches in key order, and end behind the range that meets the budgets
    (or behind ``end`` ranges). Calling it again with the same ``work`` folder
    and ``cuts`` resumes from the query checkpoint and the carried state: only
    ranges not read yet are read. Returns (output path, state path, work folder)."""
    work = work or scratch_path(spark, f"stream-pack-{uuid.uuid4().hex[:12]}")
    out_path, state_path, ckpt = f"{work}/out", f"{work}/state", f"{work}/checkpoint"
    cuts = key_cuts(lengths, key, ranges) if cuts is None else cuts
    end = last_range(lengths, key, cuts, V, T) if end is None else end
    q = (range_stream(spark, cuts, end).writeStream.foreachBatch(make_batch_fn(lengths, key, out_path, state_path, V, T))
         .option("checkpointLocation", ckpt).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()  # idle: all ranges are committed
    return out_path, state_path, work


def stream_state(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/*")
