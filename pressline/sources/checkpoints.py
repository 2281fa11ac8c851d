"""A sectioned checkpoint store (S11): tensors written by section, the manifest
last, so that a half-written save is never read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators.tensors import average_checkpoints

MANIFEST = "version long, section string, data string, tensors long, elements long, digest decimal(38,0)"
#: elements in a stored row; a larger tensor is several rows
CHUNK = 1 << 16


def _counts(t: DataFrame) -> DataFrame:
    return t.groupBy("section").agg(
        F.count_distinct("key").alias("tensors"), F.sum(F.size("values")).cast("long").alias("elements"),
        F.sum(F.xxhash64("key", "chunk", "values").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"))


def chunked(tensors: DataFrame, size: int = CHUNK) -> DataFrame:
    """Whole tensors as rows of at most ``size`` elements, numbered by ``chunk``."""
    n = F.greatest(F.ceil(F.size("values") / size).cast("int"), F.lit(1))
    cut = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
        k.cast("long").alias("chunk"), F.slice("values", k * size + 1, size).alias("part"))))
    rest = [c for c in tensors.columns if c not in ("values", "chunk")]
    return tensors.select(*rest, cut.alias("_c")).select(*rest, "_c.chunk", F.col("_c.part").alias("values"))


def save_checkpoint(tensors: DataFrame, path: str) -> int:
    """Writes rows (section, key, dtype, shape, chunk, values) as a new version
    and returns its number. The data go to a folder of their own, are read back
    and counted, and only then the manifest, one file with one row per section,
    is added: until it is there, loading gives the version before."""
    spark, path = tensors.sparkSession, path.rstrip("/")
    data = f"data-{uuid.uuid4().hex[:12]}"
    tensors.select("section", "key", "dtype", "shape", "chunk", "values").write.partitionBy("section").parquet(f"{path}/{data}")
    known = _manifest(spark, path)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1 if known is not None else 1
    counts = _counts(spark.read.parquet(f"{path}/{data}")).select(
        F.lit(version).cast("long").alias("version"), "section", F.lit(data).alias("data"), "tensors", "elements", "digest")
    counts.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_checkpoint(spark: SparkSession, path: str, sections: Sequence[str] | None = None, version: int | None = None,
                    verify: bool = True) -> DataFrame:
    """The rows of the wanted sections of the latest (or the given) version;
    the other sections' folders are not read. A missing checkpoint or section,
    or data that do not have the manifest's counts, is an error."""
    path = path.rstrip("/")
    known = _manifest(spark, path)
    rows = [] if known is None else known.where(F.lit(version is None) | (F.col("version") == F.lit(version))).collect()
    if not rows:
        raise FileNotFoundError(f"no checkpoint in {path}" + (f" of version {version}" if version else ""))
    last = max(r.version for r in rows)
    want = {r.section: r for r in rows if r.version == last}
    names = list(want) if sections is None else list(sections)
    if missing := sorted(set(names) - set(want)):
        raise FileNotFoundError(f"checkpoint {path} has no section {', '.join(missing)}")
    t = spark.read.parquet(f"{path}/{want[names[0]].data}").where(F.col("section").isin(*names))
    if verify:
        have = {r.section: (r.tensors, r.elements, r.digest) for r in _counts(t).collect()}
        if have != {s: (want[s].tensors, want[s].elements, want[s].digest) for s in names}:
            raise ValueError(f"checkpoint {path} does not hold what its manifest says")
    return t


def average_to_store(tensors: DataFrame, path: str, size: int = CHUNK, every: bool = True) -> int:
    """Averages whole tensors (chpt, key, dtype, shape, values) over their
    checkpoints (all of them, or without ``every`` those that hold a key) and saves the result as the section ``model``. Elements are
    put together ``size`` at a time, never a tensor in one group."""
    at = F.col("i")
    el = average_checkpoints(tensors, every=every).withColumn("chunk", F.floor(at / size).cast("long"))
    rows = el.groupBy("key", "dtype", "chunk").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("values"))
    shapes = tensors.groupBy("key").agg(F.min("shape").alias("shape"))
    return save_checkpoint(rows.join(shapes, "key").withColumn("section", F.lit("model")), path)
