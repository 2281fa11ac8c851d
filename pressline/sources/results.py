"""Stored evaluation results: a table keyed by request, written run by run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.hashing import Bloom


def request_key(*parts: str | Column) -> Column:
    """The identity of a request: SHA-256 over its parts, each with its length
    before it; null differs from empty."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[one(F.col(p) if isinstance(p, str) else p) for p in parts]), 256)


class ResultStore:
    """Results under ``path``, partitioned by task and run: ``upsert`` appends a
    run's rows, ``read`` gives the latest row of every key. Writing a run again
    (after a failure) replaces its partitions."""

    def __init__(self, spark: SparkSession, path: str, key: str = "req_key") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:  # nothing stored yet; any other storage error is an error
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def read(self) -> DataFrame | None:
        """The latest result of every key with the run that wrote it, or ``None``
        when nothing is stored."""
        rows = self._rows()
        if rows is None:
            return None
        cols = [c for c in rows.columns if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*cols), "run").alias("r"))
        return last.select(self.key, "r.*")

    def upsert(self, results: DataFrame, run: int) -> None:
        (results.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("task", "run").parquet(self.path))

    def split(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new work, stored results) of ``requests``, which have the key column.

        A Bloom filter of the stored keys passes requests that cannot be stored
        straight to the new work; only the others meet the store in the joins.
        Rows that repeat a request are each answered."""
        stored = self.read()
        if stored is None:
            return requests, requests.limit(0)
        held = Bloom.of(stored.select(F.xxhash64(self.key).alias("h")), "h")
        marked = requests.withColumn("_may", held.column(F.xxhash64(self.key)))
        maybe = marked.where("_may").drop("_may")
        new = marked.where("not _may").drop("_may").unionByName(maybe.join(stored.select(self.key), self.key, "left_anti").select(*requests.columns))
        extra = [c for c in stored.columns if c not in requests.columns]
        return new, maybe.join(stored.select(self.key, *extra), self.key)

    def evaluate(self, requests: DataFrame, score, run: int) -> DataFrame:
        """Scores what is not stored yet by ``score(requests) -> results`` (key,
        task and the result columns), stores it as ``run`` and returns the
        stored results of all requests."""
        new, _ = self.split(requests)
        self.upsert(score(new.dropDuplicates([self.key])), run)
        return self.split(requests)[1]
