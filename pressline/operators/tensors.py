"""Checkpoint tensors as tables.

A tensor is a row ``(chpt, key, dtype, shape, values ARRAY<DOUBLE>)``; very
large tensors are stored as several chunk rows with a ``chunk`` column. All
element-wise work explodes elements and aggregates by ``(key, i)``, so the
partial aggregation leaves one row per element per task before the shuffle
and no tensor is ever gathered in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.fixed import CHPT_DIR_PART

FLOAT_DTYPES = ["float16", "bfloat16", "float32", "float64"]


def checkpoint_path(root: str, prefix: Column | str, name: Column | str, updates: Column,
                    optional_prefix: str = "") -> Column:
    """``root/<prefix><name>/<optional_prefix>num_grad_updates_<N>``."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    n = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit(root.rstrip("/") + "/"), p, n, F.lit("/" + optional_prefix + CHPT_DIR_PART),
                    updates.cast("string"))


def updates_from_path(path: Column) -> Column:
    return F.regexp_extract(path, CHPT_DIR_PART + r"(\d+)", 1).cast("long")


def eligible_for_average(catalog: DataFrame, stage: str = "stage", distinct: bool = True) -> DataFrame:
    """A1: only checkpoints saved in annealing or after completion; by default
    a path listed twice (last periodic save == final save) counts once."""
    t = catalog.filter(F.col(stage).isin("annealing_stage", "complete"))
    return t.dropDuplicates(["path"]) if distinct else t


def key_compat(tensors: DataFrame, first_chpt: Column) -> DataFrame:
    """A3: per checkpoint, how many keys of the first checkpoint it lacks
    (``missing``) and how many it adds (``extra``); any non-zero count is the
    reference's key-set mismatch error. Semi and anti joins only."""
    base = tensors.filter(F.col("chpt") == first_chpt).select("key").distinct()
    n_base = base.select(F.count(F.lit(1))).scalar()
    present = tensors.select("chpt", "key").distinct()
    matched = present.join(base, "key", "left_semi").groupBy("chpt").agg(F.count(F.lit(1)).alias("_m"))
    extra = present.join(base, "key", "left_anti").groupBy("chpt").agg(F.count(F.lit(1)).alias("extra"))
    chpts = present.select("chpt").distinct()
    t = chpts.join(matched, "chpt", "left").join(extra, "chpt", "left")
    return t.select("chpt", (n_base - F.coalesce(F.col("_m"), F.lit(0))).cast("long").alias("missing"),
                    F.coalesce(F.col("extra"), F.lit(0)).cast("long").alias("extra"))


def shape_compat(tensors: DataFrame, first_chpt: Column) -> DataFrame:
    """A4: (chpt, key) whose shape differs from the first checkpoint's."""
    base = tensors.filter(F.col("chpt") == first_chpt).select("key", F.col("shape").alias("_s0"))
    t = tensors.join(base, "key").filter(F.col("shape") != F.col("_s0"))
    return t.select("chpt", "key", "shape", F.col("_s0").alias("expected_shape"))


def average_checkpoints(tensors: DataFrame, dtype: str = "dtype", every: bool = True) -> DataFrame:
    """A2: element-wise mean of float tensors over the given checkpoints, rounded
    back to the tensor's dtype; non-float tensors come from the first
    checkpoint. Output one row per element ``(key, dtype, i, value)``. A key
    that is not in every checkpoint, or whose shapes differ, is an error when
    the plan runs. Without ``every`` a key is averaged over the checkpoints that
    hold it: a run's last one may not have them all."""
    if every:
        n = tensors.select(F.count_distinct("chpt")).scalar()
    else:  # of every key the checkpoints that hold it, beside its tensors, not its elements
        held = tensors.filter(F.size("values") > 0).groupBy("key").agg(F.count_distinct("chpt").alias("_m"))
        tensors, n = tensors.join(held, "key"), F.col("_m")
    fits = (F.col("_n") == n) & F.col("_lo").eqNullSafe(F.col("_hi"))
    misfit = F.raise_error(F.concat(F.lit("checkpoints differ in tensor "), F.col("key"))).cast("double")
    check = [F.count(F.lit(1)).alias("_n"), F.min("shape").alias("_lo"), F.max("shape").alias("_hi")]
    is_float = F.col(dtype).isin(*FLOAT_DTYPES)
    if not every:
        check.append(F.max("_m").alias("_m"))
    el = tensors.select("chpt", "key", dtype, "shape", *([] if every else ["_m"]), F.posexplode("values").alias("i", "v"))
    fl = el.filter(is_float).groupBy("key", dtype, "i").agg(F.avg("v").alias("_v"), *check)
    nf = el.filter(~is_float).groupBy("key", dtype, "i").agg(F.min_by("v", "chpt").alias("_v"), *check)
    fl = fl.withColumn("_v", round_to_dtype(F.col("_v"), F.col(dtype)))
    return fl.unionByName(nf).select("key", dtype, "i", F.when(fits, F.col("_v")).otherwise(misfit).alias("value"))


def round_to_dtype(v: Column, dtype: Column) -> Column:
    """The nearest value (ties to even) of a float dtype, as a double."""
    def nearest(bits: int, least: int, most: float) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))) - bits, F.lit(least)))
        r = F.when(v == 0, v).otherwise(F.rint(v / step) * step)
        return F.when(F.abs(r) > most, F.signum(v) * F.lit(float("inf"))).otherwise(r)

    return (F.when(dtype == "float32", v.cast("float").cast("double"))
            .when(dtype == "float16", nearest(10, -24, 65504.0))
            .when(dtype == "bfloat16", nearest(7, -133, 3.3895313892515355e38)).otherwise(v))


def param_count(tensors: DataFrame, by: list[str]) -> DataFrame:
    """A5: total element count."""
    return tensors.groupBy(*by).agg(F.sum(F.size("values")).cast("long").alias("params"))
