"""Vector-column operators on ``ARRAY<DOUBLE>`` columns (V1-V6).

Higher-order array functions keep the maths inside whole-stage codegen; the
only joins are id lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding_lookup(tokens: DataFrame, emb: DataFrame, id_col: str = "id", key: str = "vec_id",
                     vec: str = "embedding") -> DataFrame:
    """V1: attach the embedding row of each token id. A plain equi-join without
    an action or a hint: by the sizes it sees at runtime, adaptive execution
    broadcasts the table or shuffles both sides and splits the partitions of
    hot ids."""
    return tokens.join(emb.withColumnRenamed(key, id_col), on=id_col, how="inner")


def rms_norm(x: Column, weight: Column, eps: float) -> Column:
    """V2: ``x * rsqrt(mean(x^2) + eps) * weight``."""
    ms = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x)
    inv = F.lit(1.0) / F.sqrt(ms + F.lit(eps))
    return F.zip_with(x, weight, lambda v, w: v * inv * w)


def rope_angles(pos: Column, d: int, theta: float) -> Column:
    """V3: ``pos * theta^(-2i/d)`` for i in 0..d/2-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(d // 2 - 1)),
                       lambda i: pos.cast("double") * F.pow(F.lit(theta), -2.0 * i / F.lit(float(d))))


def rope_rotate(x: Column, pos: Column, theta: float) -> Column:
    """V4: rotate pairs ``(x[2i], x[2i+1])`` by the angle of ``pos``."""
    d = F.size(x)

    def rot(i):
        ang = pos.cast("double") * F.pow(F.lit(theta), (-2.0 * F.floor(i / 2)) / d)
        a = F.element_at(x, (F.floor(i / 2) * 2 + 1).cast("int"))
        b = F.element_at(x, (F.floor(i / 2) * 2 + 2).cast("int"))
        return F.when(i % 2 == 0, a * F.cos(ang) - b * F.sin(ang)).otherwise(a * F.sin(ang) + b * F.cos(ang))

    return F.transform(F.sequence(F.lit(0), d - 1), rot)


def dot(x: Column, w: Column) -> Column:
    """V5: ``sum(x * w)``."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def terminal_score(df: DataFrame, by: list[str], pos: str, score: str) -> DataFrame:
    """V6: a response's score is the score at its last token."""
    return df.groupBy(*by).agg(F.max_by(score, pos).alias("terminal_score"))
