"""Registered queries: checkpoint catalog and tensor operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators import tensors as A
from pressline.plans.fixtures import SQL_TENSORS, tensors
from pressline.plans.registry import register, with_ctes
from pressline.session import scratch_path
from pressline.sources.checkpoints import average_to_store, chunked, load_checkpoint, save_checkpoint


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One row per checkpoint: saved at 200 (c + 1) updates; the stage by the
    checkpoint's place in the run (first 40 % initial, next 20 % long-context,
    then annealing; the last one is the final save)."""
    t = tensors(spark, sf).select("chpt").distinct()
    n = tensors(spark, sf).select(F.max("chpt") + 1).scalar()
    idx = F.col("chpt") + 1
    stage = (F.when(idx == n, F.lit("complete")).when(idx * 5 <= n * 2, F.lit("initial_stage"))
             .when(idx * 5 <= n * 3, F.lit("lc_stage")).otherwise(F.lit("annealing_stage")))
    path = A.checkpoint_path("chpts", "", "fixture_base", idx * 200)
    return t.select("chpt", path.alias("path"), stage.alias("stage"))


SQL_CAT = SQL_TENSORS + """,
cat AS (
  SELECT c.chpt, 'chpts/fixture_base/num_grad_updates_' || CAST(200 * (c.chpt + 1) AS VARCHAR) AS path,
         CASE WHEN c.chpt + 1 = m.n THEN 'complete' WHEN (c.chpt + 1) * 5 <= m.n * 2 THEN 'initial_stage'
              WHEN (c.chpt + 1) * 5 <= m.n * 3 THEN 'lc_stage' ELSE 'annealing_stage' END AS stage
  FROM (SELECT DISTINCT chpt FROM tensors) c, (SELECT max(chpt) + 1 AS n FROM tensors) m
),
elig AS (SELECT * FROM cat WHERE stage IN ('annealing_stage', 'complete'))"""


@register("checkpoint_catalog", sql=with_ctes(SQL_CAT, body="""
SELECT chpt, path, CAST(regexp_extract(path, 'num_grad_updates_(\\d+)', 1) AS BIGINT) AS num_grad_updates, stage FROM cat"""))
def checkpoint_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf)
    return c.select("chpt", "path", A.updates_from_path(F.col("path")).alias("num_grad_updates"), "stage")


@register("anneal_checkpoints", sql=with_ctes(SQL_CAT, body="SELECT chpt, path FROM elig"))
def anneal_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return A.eligible_for_average(catalog(spark, sf)).select("chpt", "path")


SQL_AVERAGED = with_ctes(SQL_CAT, """
el AS (
  SELECT t.chpt, t.key, t.dtype, i - 1 AS i, v
  FROM (SELECT chpt, key, dtype, unnest(vals) AS v, generate_subscripts(vals, 1) AS i
        FROM tensors WHERE chpt IN (SELECT chpt FROM elig)) t
)""", """
avg_t AS (
  SELECT key, dtype, CAST(i AS INTEGER) AS i,
         CASE WHEN dtype = 'float32' THEN CAST(CAST(avg(v) AS FLOAT) AS DOUBLE) ELSE arg_min(v, chpt) END AS value
  FROM el GROUP BY key, dtype, i)""", body="")


@register("average_checkpoints", sql=SQL_AVERAGED + "SELECT * FROM avg_t")
def average_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """A2: element-wise average over the eligible checkpoints that hold a tensor."""
    el = A.eligible_for_average(catalog(spark, sf)).select("chpt")
    t = tensors(spark, sf).join(el, "chpt", "left_semi")
    return A.average_checkpoints(t, every=False).select("key", "dtype", F.col("i").cast("int"), "value")


@register("key_compat", sql=with_ctes(SQL_TENSORS, """
base AS (SELECT DISTINCT key FROM tensors WHERE chpt = (SELECT min(chpt) FROM tensors)),
pres AS (SELECT DISTINCT chpt, key FROM tensors)""", body="""
SELECT c.chpt, CAST((SELECT count(*) FROM base) - count(b.key) AS BIGINT) AS missing,
       CAST(count(*) FILTER (WHERE b.key IS NULL) AS BIGINT) AS extra
FROM pres c LEFT JOIN base b USING (key) GROUP BY c.chpt"""))
def key_compat(spark: SparkSession, sf: str) -> DataFrame:
    t = tensors(spark, sf)
    first = t.select(F.min("chpt")).scalar()
    return A.key_compat(t, first)


@register("shape_compat", sql=with_ctes(SQL_TENSORS, body="""
SELECT t.chpt, t.key FROM tensors t JOIN tensors b ON b.key = t.key AND b.chpt = (SELECT min(chpt) FROM tensors)
WHERE t.shape <> b.shape"""))
def shape_compat(spark: SparkSession, sf: str) -> DataFrame:
    t = tensors(spark, sf)
    return A.shape_compat(t, t.select(F.min("chpt")).scalar()).select("chpt", "key")


@register("param_count", sql=with_ctes(SQL_TENSORS, body="""
SELECT chpt, CAST(sum(len(vals)) AS BIGINT) AS params FROM tensors GROUP BY chpt"""))
def param_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.param_count(tensors(spark, sf), ["chpt"])


@register("checkpoint_load", sql=with_ctes(SQL_TENSORS, body="""
SELECT CASE WHEN CAST(substr(key, 2) AS INTEGER) < 80 THEN 'model'
            WHEN CAST(substr(key, 2) AS INTEGER) < 95 THEN 'optimizer' ELSE 'history' END AS section,
       CAST(count(*) AS BIGINT) AS tensors, CAST(sum(len(vals)) AS BIGINT) AS elements
FROM tensors WHERE chpt = (SELECT max(chpt) FROM tensors)
  AND CAST(substr(key, 2) AS INTEGER) < 80
GROUP BY 1"""))
def checkpoint_load(spark: SparkSession, sf: str) -> DataFrame:
    """The latest checkpoint saved by section (weights, optimizer,
    history), then the weights loaded alone."""
    t = tensors(spark, sf)
    kn = F.substring("key", 2, 10).cast("int")
    section = F.when(kn < 80, "model").when(kn < 95, "optimizer").otherwise("history")
    t = t.withColumn("section", section).filter(F.col("chpt") == t.select(F.max("chpt")).scalar())
    path = scratch_path(spark, f"checkpoint-{uuid.uuid4().hex[:12]}")
    save_checkpoint(chunked(t.drop("chpt"), 48), path)
    back = load_checkpoint(spark, path, ["model"])
    return back.groupBy("section").agg(F.count_distinct("key").alias("tensors"), F.sum(F.size("values")).cast("long").alias("elements"))


@register("averaged_checkpoint", sql=SQL_AVERAGED + """
SELECT 'model' AS section, key, dtype, CAST(count(*) AS BIGINT) AS elements, round(sum(value), 6) AS value_sum
FROM avg_t GROUP BY key, dtype""")
def averaged_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The average of the eligible checkpoints, saved and loaded again."""
    el = A.eligible_for_average(catalog(spark, sf)).select("chpt")
    path = scratch_path(spark, f"averaged-{uuid.uuid4().hex[:12]}")
    average_to_store(tensors(spark, sf).join(el, "chpt", "left_semi"), path, 50, every=False)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return load_checkpoint(spark, path).groupBy("section", "key", "dtype").agg(
        F.sum(F.size("values")).cast("long").alias("elements"), F.round(F.sum(total), 6).alias("value_sum"))
