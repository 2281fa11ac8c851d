"""SparkSession helper and shared-storage locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "pressline") -> SparkSession:
    """Session with the settings every operator assumes.

    AQE (coalescing + skew-join splitting) is on, time zone is UTC, the UI is
    off. On a cluster pass ``master=None`` and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # long documents: keep Arrow batches small enough for one task's memory
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", os.environ.get("PRESSLINE_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared
    folder there). Only when it is unset (local tests) is a scratch folder
    created and set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        # local runs and tests only: a scratch folder on this machine
        conf = tempfile.mkdtemp(prefix="pressline-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def materialize(df):
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The data is written under ``spark.checkpoint.dir`` (a shared folder on a
    cluster), so a lost executor does not force recomputation of the plan
    above it, and plans that reuse ``df`` several times stay small.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_table(df, name: str):
    """Cut lineage by writing ``df`` as a Parquet table under the shared
    checkpoint folder and reading it back (columnar, compressed, readable by
    any executor; cheaper than a serialized RDD checkpoint for wide rows)."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
