"""Sinks: token store (S5), stage sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_sidecar(split: DataFrame, cfg: DataFrame, vocab_size: int) -> DataFrame:
    """One row per stage with targets, written counts and the JSON sidecar.

    A short corpus ends under target silently; the sidecar is where it shows.
    """
    written = split.groupBy("stage").agg(
        F.sum("train_take").cast("long").alias("total_train_written"),
        F.sum("val_take").cast("long").alias("total_val_written"))
    t = written.join(cfg.select("stage", "train_target", "val_target"), "stage")
    t = t.select(
        "stage", F.lit(vocab_size).alias("vocab_size"),
        F.col("train_target").alias("train_tokens_target"), "total_train_written",
        F.col("val_target").alias("val_tokens_target"), "total_val_written")
    return t.withColumn("sidecar", F.to_json(F.struct(
        "stage", "vocab_size", "train_tokens_target", "total_train_written",
        "val_tokens_target", "total_val_written")))


def store_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 1 << 16 else "uint32"


def write_tokens(pieces: DataFrame, path: str, mode: str = "overwrite", vocab_size: int = 1 << 32) -> None:
    """Store split pieces partitioned by (stage, split). An id outside
    ``[0, vocab_size)`` fails the write, as it would not fit the declared
    ``store_dtype``.

    Rows are ``(doc_id, pstart, pend, take, ids ARRAY<INT>)``; files are sorted by
    ``pstart`` inside each partition so Parquet min/max statistics let a
    position-range read skip row groups (the random access of a memory map).
    """
    outside = (F.array_max("ids") >= F.lit(vocab_size)) | (F.array_min("ids") < 0)
    ids = F.when(outside, F.raise_error(F.lit(f"token id outside {store_dtype(vocab_size)} vocabulary of {vocab_size}"))).otherwise(F.col("ids"))
    (pieces.select("stage", "split", "doc_id", "pstart", (F.col("pstart") + F.col("take")).alias("pend"), "take", ids.alias("ids"))
     .repartition("stage", "split", F.floor(F.col("pstart") / F.lit(1 << 24)))
     .sortWithinPartitions("pstart")
     .write.mode(mode).partitionBy("stage", "split").parquet(path))


def read_tokens(spark, path: str, stage: str, split: str, lo: int | None = None,
                hi: int | None = None) -> DataFrame:
    """Read a stored stream; partition pruning on (stage, split) and a
    pushed-down ranges on ``pstart`` and ``pend`` select only the pieces overlapping
    ``[lo, hi)``."""
    df = spark.read.parquet(path).filter((F.col("stage") == stage) & (F.col("split") == split))
    if hi is not None:
        df = df.filter(F.col("pstart") < F.lit(hi))
    if lo is not None:
        df = df.filter(F.col("pend") > F.lit(lo))
    return df


def read_blocks(spark, path: str, stage: str, split: str, L: int, first: int, last: int) -> DataFrame:
    """K7/K11 on a stored stream: the blocks ``first .. last``, read from the
    pieces that overlap their positions only."""
    from pressline.operators.packing import make_blocks, stream_lengths

    lens = stream_lengths(read_tokens(spark, path, stage, split).select("stage", "split", "take"))
    pieces = read_tokens(spark, path, stage, split, first * L, (last + 1) * L + 1)
    return make_blocks(pieces, L, lens=lens, first=first, last=last)
