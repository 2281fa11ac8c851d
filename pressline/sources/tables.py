"""Table scans.

Scans are plain ``spark.read`` calls; column pruning and filter pushdown into
Parquet come from Catalyst as long as callers ``select``/``filter`` on plain
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm.common import importable

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table (one parquet file or folder). What Python
    workers do with it finds this package, and gets Arrow batches of bounded bytes."""
    importable(spark)
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_catalog(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    """Catalog of (name, config) dataset identities, one row per dataset."""
    return spark.createDataFrame(rows, "name string, config string")


def corpus_scan(spark: SparkSession, sf_dir: str, name: str = "documents",
                config: str | None = None, config_column: str = "lang") -> DataFrame:
    """Scan a named dataset; an optional ``config`` selects one subset.

    The subset is a pushed-down equality filter on ``config_column``.
    """
    df = table(spark, sf_dir, name)
    if config is not None:
        df = df.filter(F.col(config_column) == F.lit(config))
    return df


def head_sample(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """S3: the first ``n`` documents in ``order`` (a top-k, planned as
    TakeOrderedAndProject: each task keeps only its own best ``n``)."""
    return docs.orderBy(order).limit(n)


def batched_scan(docs: DataFrame, batch_size: int, order: str = "doc_id") -> DataFrame:
    """Assign each document its batch number ``floor(rank / batch_size)``.

    The rank is a distributed row index (two-level prefix count), never a
    global single-partition window.
    """
    from pressline.operators.ordered import row_index

    r = row_index(docs, order, "_rank")
    return r.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch_size).cast("long")).drop("_rank")
