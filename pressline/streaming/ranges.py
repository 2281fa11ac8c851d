"""A streaming source of key ranges with offsets of its own.

Each micro-batch brings one range ``(index, lo, hi]`` of an integer key; the
batch function reads that range from the table, with the range pushed into its
scan. So a table is replayed in key order without staging it as files, any
number of tasks read a range, an offset is the number of the next range, and a
restarted query goes on behind the last committed one. The source ends itself:
behind range ``end`` there is no more data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "index long, lo long, hi long"


class _RangeReader(SimpleDataSourceStreamReader):
    def __init__(self, cuts: list[int], end: int) -> None:
        self.cuts, self.end = cuts, end

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def _rows(self, first: int, behind: int) -> Iterator[tuple]:
        bounds = [None, *self.cuts, None]
        return iter([(i, bounds[i], bounds[i + 1]) for i in range(first, behind)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        i = start["next"]
        if i >= min(self.end, len(self.cuts) + 1):
            return iter([]), start
        return self._rows(i, i + 1), {"next": i + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._rows(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        pass


class KeyRanges(DataSource):
    """Options: ``cuts``, a JSON list of ascending keys between the ranges, and
    ``end``, the number of ranges to serve."""

    @classmethod
    def name(cls) -> str:
        return "key_ranges"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _RangeReader(json.loads(self.options["cuts"]), int(self.options["end"]))


def key_cuts(table: DataFrame, key: str, ranges: int) -> list[int]:
    """Keys that part a table into about ``ranges`` equal ranges."""
    if ranges < 2:
        return []
    q = table.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    return sorted(set(q or []))


def range_number(key: str, cuts: list[int]) -> F.Column:
    """The range that a key falls into, by binary search."""
    at = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(at, n + s - 1) < F.col(key), n + s).otherwise(n))


def rows_of(table: DataFrame, key: str, lo: int | None, hi: int | None) -> DataFrame:
    """The rows of a range; null keys belong to the first one."""
    if lo is None:
        return table if hi is None else table.where((F.col(key) <= F.lit(hi)) | F.col(key).isNull())
    return table.where((F.col(key) > F.lit(lo)) & (F.lit(hi is None) | (F.col(key) <= F.lit(hi))))


def range_stream(spark: SparkSession, cuts: list[int], end: int) -> DataFrame:
    spark.dataSource.register(KeyRanges)
    return spark.readStream.format("key_ranges").option("cuts", json.dumps(cuts)).option("end", end).load()
