"""Registered queries: vector-column operators (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.bytes_ import byte_ids, duck_byte_ids_sql
from pressline.operators import vectors as V
from pressline.plans.fixtures import SQL_LOGITS, logits
from pressline.plans.registry import register, with_ctes
from pressline.sources.tables import table

THETA = 500_000.0
EPS = 1e-5


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _weights(x: F.Column, kind: str) -> F.Column:
    idx = F.sequence(F.lit(0), F.size(x) - 1)
    if kind == "norm":
        return F.transform(idx, lambda i: F.lit(1.0) + F.lit(0.01) * i)
    return F.transform(idx, lambda i: ((i % 7) - 3) / F.lit(10.0))


@register("embedding_lookup", sql=f"""
WITH tok AS (SELECT item_id AS item, unnest({duck_byte_ids_sql('text')}) AS id FROM benchmark)
SELECT t.item, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(e.label) AS BIGINT) AS label_sum,
       round(sum(list_sum(CAST(e.embedding AS DOUBLE[]))), 6) AS emb_sum
FROM tok t JOIN embeddings e ON e.vec_id = t.id GROUP BY t.item""")
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """V1: byte-level ids of each benchmark text joined to their embedding rows."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.explode(byte_ids(F.col("text"))).alias("id"))
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    j = V.embedding_lookup(b, e, vec="embedding")
    return j.groupBy("item").agg(F.count(F.lit(1)).alias("tokens"), F.sum("label").cast("long").alias("label_sum"),
                                 F.round(F.sum(V.array_sum(F.col("embedding"))), 6).alias("emb_sum"))


@register("rms_norm", sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (
  SELECT vec_id, list_transform(range(len(x)), lambda i: x[i + 1] * (1.0 / sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + {EPS}))
                                          * (1.0 + 0.01 * i)) AS y FROM e
)
SELECT vec_id, round(list_sum(y), 6) AS norm_sum, round(y[1], 6) AS norm_first FROM n""")
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    y = V.rms_norm(F.col("x"), _weights(F.col("x"), "norm"), EPS)
    return e.select("vec_id", y.alias("y")).select(
        "vec_id", F.round(V.array_sum(F.col("y")), 6).alias("norm_sum"), F.round(F.element_at("y", 1), 6).alias("norm_first"))


@register("rope_table", sql=f"""
SELECT p.pos, CAST(i AS INTEGER) AS i, round(cos(p.pos * pow({THETA}, -2.0 * i / 64)), 9) AS cos,
       round(sin(p.pos * pow({THETA}, -2.0 * i / 64)), 9) AS sin
FROM (SELECT DISTINCT vec_id % 64 AS pos FROM embeddings) p, range(32) t(i)""")
def rope_table(spark: SparkSession, sf: str) -> DataFrame:
    """V3: cos / sin of ``pos * theta^(-2i/d)`` for the positions present (d = 64)."""
    p = table(spark, sf, "embeddings").select((F.col("vec_id") % 64).alias("pos")).distinct()
    a = p.select("pos", F.posexplode(V.rope_angles(F.col("pos"), 64, THETA)).alias("i", "ang"))
    return a.select("pos", F.col("i").cast("int"), F.round(F.cos("ang"), 9).alias("cos"), F.round(F.sin("ang"), 9).alias("sin"))


@register("rope_rotate", sql=f"""
WITH e AS (SELECT vec_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
r AS (
  SELECT vec_id, list_transform(range(len(x)), lambda i:
     CASE WHEN i % 2 = 0 THEN x[i + 1] * cos(pos * pow({THETA}, -2.0 * (i // 2) / len(x))) - x[i + 2] * sin(pos * pow({THETA}, -2.0 * (i // 2) / len(x)))
          ELSE x[i] * sin(pos * pow({THETA}, -2.0 * (i // 2) / len(x))) + x[i + 1] * cos(pos * pow({THETA}, -2.0 * (i // 2) / len(x))) END) AS y
  FROM e
)
SELECT vec_id, round(list_sum(y), 6) + 0.0 AS rot_sum, round(y[1], 6) + 0.0 AS rot0, round(y[2], 6) + 0.0 AS rot1 FROM r""")
def rope_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """V4: rotary rotation of each vector at position ``vec_id mod 8``."""
    e = _emb(spark, sf).withColumn("pos", F.col("vec_id") % 8)
    y = V.rope_rotate(F.col("x"), F.col("pos"), THETA)
    r = e.select("vec_id", y.alias("y"))
    # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines hash the same value
    return r.select("vec_id", (F.round(V.array_sum(F.col("y")), 6) + 0.0).alias("rot_sum"),
                    (F.round(F.element_at("y", 1), 6) + 0.0).alias("rot0"),
                    (F.round(F.element_at("y", 2), 6) + 0.0).alias("rot1"))


SQL_SCORE = "list_sum(list_transform(range(len(x)), lambda i: x[i + 1] * ((i % 7) - 3) / 10.0))"


@register("score_head", sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round({SQL_SCORE}, 6) AS score FROM e""")
def score_head(spark: SparkSession, sf: str) -> DataFrame:
    """V5: scalar score = dot(vector, weight), no bias."""
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(V.dot(F.col("x"), _weights(F.col("x"), "head")), 6).alias("score"))


@register("terminal_score", sql=with_ctes(SQL_LOGITS, body=f"""
SELECT doc, round(arg_max({SQL_SCORE.replace('x', 'logits').replace('lambda i: logits', 'lambda i: logits')}, pos), 6) AS terminal_score
FROM logits_t GROUP BY doc"""))
def terminal_score(spark: SparkSession, sf: str) -> DataFrame:
    """V6: per response (doc), the score at its last token."""
    lg = logits(spark, sf)
    s = lg.withColumn("score", V.dot(F.col("logits"), _weights(F.col("logits"), "head")))
    t = V.terminal_score(s, ["doc"], "pos", "score")
    return t.select("doc", F.round("terminal_score", 6).alias("terminal_score"))
