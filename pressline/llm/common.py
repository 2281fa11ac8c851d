"""Shared helpers: table access, written intermediate tables, Arrow plumbing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pressline.session import materialize_table

#: bytes of text that the numpy code handles at once; a longer text is handled alone
CHUNK_BYTES = 1 << 20


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the
    driver has it, whatever folder they start in (a cluster installs it), and
    bounds the Arrow batches of long texts unless the session sets a size."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # untouched: whole texts need smaller Arrow batches
        spark.conf.set(_BATCH_BYTES, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(names: list[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, each with as many underscores behind it as keep it
    apart from ``names``, upper or lower case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back, so
    that lost executors never recompute what stands above."""
    return materialize_table(df, f"llm-{name}")


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def spans_of(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, at least one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def map_text(docs: DataFrame, fn: Callable, schema: str, keys: tuple[str, ...] = ("doc_id",),
             text: str = "text") -> DataFrame:
    """``fn(buf, off) -> dict of columns`` over chunks of whole texts; one
    output row per input row, the key columns carried along."""
    out = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(len(keys)))
            for i, j in spans_of(off):
                cols = fn(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                got = [b.column(k).slice(i, j - i) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    got + [c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()],
                    names=list(keys) + list(cols))

    return docs.select(*keys, text).mapInArrow(run, f"{out}, {schema}")
