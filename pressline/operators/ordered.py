"""Order-dependent computations without single-partition windows.

A plain ``Window.orderBy(...)`` (or one partitioned by a hot key such as a run
name) moves every row of the group onto one task. The helpers here keep every
task bounded:

* ``prefix_sums`` -- exclusive running totals in two levels: rows fall into
  ranges of (group, key) with about equal row counts, whatever the key looks
  like, by splitters drawn from a sample of it; the totals of the ranges are
  summed up and joined back for a local window per range.
* ``with_halo`` -- for dense step numbers, copies the few neighbouring rows a
  bounded frame (lag) needs from the adjacent bucket, so the window can be
  partitioned by (group, bucket).
* ``ema`` -- the exponential moving average as an associative scan of affine
  maps over several levels.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# rows per bucket: large enough to keep the bucket table tiny, small enough
# to sort inside one task without spilling
DEFAULT_BUCKET_ROWS = 1 << 17
# buckets at most, as their splitters travel with the plan, and sampled keys per
# bucket; beyond MAX_BUCKETS * bucket_rows rows the buckets grow and their sorts spill
MAX_BUCKETS, SAMPLED_KEYS = 1 << 13, 32


def _cols(xs: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in xs]


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys match each other."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"_r_{c}"])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def range_bucket(df: DataFrame, order: str, by: Sequence[str] = (), bucket_rows: int = DEFAULT_BUCKET_ROWS) -> Column:
    """Number of a row's range of (``by``, ``order``), ranges being in that
    order and of about ``bucket_rows`` rows each.

    The splitters are quantiles of a uniform sample of the keys themselves, of
    any type that sorts: dense, sparse and hashed integers or strings give
    equal ranges alike. Two light jobs over the key columns, a count and the
    sample; at most MAX_BUCKETS splitters come to the driver. A row finds its
    range by binary search. Rows with equal keys share a range."""
    n = df.count()
    parts = min(MAX_BUCKETS, -(-n // bucket_rows))
    if parts <= 1:
        return F.lit(0)
    key = F.struct(*by, order)
    each = SAMPLED_KEYS
    sample = df.select(key.alias("k")).sample(min(1.0, each * parts / n), seed=7)
    # as many keys apart as give ``parts`` ranges of the sample that was drawn
    ranked = F.array_sort(F.collect_list("k"))
    every = F.greatest(F.lit(1), F.floor(F.size(ranked) / parts))
    picked = sample.agg(ranked.alias("k"), every.alias("e")).select(
        F.expr("to_json(array_distinct(filter(k, (x, i) -> i > 0 and i % e = 0)))")).first()[0]
    kind = T.ArrayType(df.select(key.alias("k")).schema["k"].dataType)
    splits = F.from_json(F.lit(picked), kind)
    steps = F.array(*[F.lit(1 << i) for i in range(parts.bit_length(), -1, -1)])
    # the number of splitters that are not above the key
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(splits, at + s - 1) <= key, at + s).otherwise(at))


def prefix_sums(
    df: DataFrame,
    order: str,
    values: Mapping[str, Column | str],
    by: Sequence[str] = (),
    inclusive: bool = False,
    bucket_rows: int = DEFAULT_BUCKET_ROWS,
) -> DataFrame:
    """Add running totals of ``values`` over rows ordered by ``order``.

    ``order`` is unique within each ``by`` group and of any type that sorts.
    Output column ``name`` is the sum over strictly earlier rows
    (``inclusive=False``) or up to and including the row.

    The first level is a window per (group, range), ranges of about
    ``bucket_rows`` rows from ``range_bucket``; the second one runs over the
    range totals, at most one row per group and range. AQE sees the size of
    that table at runtime and broadcasts it only under its threshold.
    """
    by = list(by)
    names = list(values)
    vals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    tmp = {k: f"_pv_{i}" for i, k in enumerate(names)}
    off = {k: f"_po_{i}" for i, k in enumerate(names)}
    base = df.withColumn("_pb", range_bucket(df, order, by, bucket_rows))
    for k in names:
        base = base.withColumn(tmp[k], vals[k])

    offs = base.groupBy(*by, "_pb").agg(*[F.sum(tmp[k]).alias(tmp[k]) for k in names])
    wb = Window.partitionBy(*by).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    for k in names:
        offs = offs.withColumn(off[k], F.coalesce(F.sum(tmp[k]).over(wb), F.lit(0)))

    joined = join_null_safe(base, offs.select(*by, "_pb", *off.values()), [*by, "_pb"])
    frame_end = Window.currentRow if inclusive else -1
    wl = (Window.partitionBy(*by, "_pb").orderBy(order)
          .rowsBetween(Window.unboundedPreceding, frame_end))
    for k in names:
        joined = joined.withColumn(k, F.col(off[k]) + F.coalesce(F.sum(tmp[k]).over(wl), F.lit(0)))
    return joined.drop("_pb", *tmp.values(), *off.values())


def row_index(df: DataFrame, order: str, out: str, by: Sequence[str] = (),
              bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """1-based position of each row within ``by`` groups ordered by ``order``."""
    r = prefix_sums(df, order, {out: F.lit(1).cast("long")}, by=by,
                    inclusive=True, bucket_rows=bucket_rows)
    return r


def with_halo(df: DataFrame, step: str, before: int, after: int,
              bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Tag rows with ``_bucket`` (by dense 1-based ``step``) and add halo copies.

    A row also appears, flagged ``_halo``, in the next bucket when it is among
    the last ``before`` rows of its bucket and in the previous bucket when it
    is among the first ``after`` rows. A window partitioned by
    (group, ``_bucket``) with a frame no wider than (before, after) then sees
    every row it needs; drop the ``_halo`` rows afterwards.
    """
    if before >= bucket_rows or after >= bucket_rows:
        raise ValueError("halo wider than a bucket")
    s0 = F.col(step) - 1
    b = F.floor(s0 / bucket_rows).cast("long")
    pos = s0 - b * bucket_rows
    home = F.array(F.struct(b.alias("_bucket"), F.lit(False).alias("_halo")))
    empty = F.array().cast("array<struct<_bucket:bigint,_halo:boolean>>")
    nxt = F.when(pos >= bucket_rows - before,
                 F.array(F.struct((b + 1).alias("_bucket"), F.lit(True).alias("_halo"))))
    prv = F.when((pos < after) & (b > 0),
                 F.array(F.struct((b - 1).alias("_bucket"), F.lit(True).alias("_halo"))))
    targets = F.concat(home, F.coalesce(nxt, empty), F.coalesce(prv, empty))
    return (df.withColumn("_t", F.explode(targets))
              .select("*", "_t._bucket", "_t._halo").drop("_t"))


def lag_by_step(df: DataFrame, by: Sequence[str], step: str,
                cols: Mapping[str, str], offset: int = 1,
                bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """``lag(col, offset)`` over ``by`` ordered by a dense 1-based ``step``."""
    h = with_halo(df, step, before=offset, after=0, bucket_rows=bucket_rows)
    w = Window.partitionBy(*by, "_bucket").orderBy(step)
    for out, src in cols.items():
        h = h.withColumn(out, F.lag(src, offset).over(w))
    return h.filter(~F.col("_halo")).drop("_bucket", "_halo")


def _composed(maps: DataFrame, by: Sequence[str], size: int, levels: int) -> DataFrame:
    """(by, _i, _a, _b), maps ``x -> _a x + _b`` in the order of ``_i``, to
    (by, _i, _pa, _pb), the composition of all maps before ``_i``. Maps are
    composed in groups of ``size`` neighbours, the groups' maps in the same way
    ``levels`` times over; the last level takes what is left of a group."""
    by = list(by)
    g = F.floor(F.col("_i") / size).cast("long") if levels else F.lit(0).cast("long")
    lists = maps.groupBy(*by, g.alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_i", "_a", "_b"))).alias("_m"))
    none = F.array().cast("array<struct<_i:bigint,_la:double,_lb:double>>")
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), none.alias("before"))
    fold = F.aggregate("_m", start, lambda at, m: F.struct(
        (at["a"] * m["_a"]).alias("a"), (m["_a"] * at["b"] + m["_b"]).alias("b"),
        F.concat(at["before"], F.array(F.struct(m["_i"].alias("_i"), at["a"].alias("_la"), at["b"].alias("_lb")))).alias("before")))
    t = lists.select(*by, "_g", fold.alias("_f"))
    local = t.select(*by, "_g", F.inline("_f.before"))
    if not levels:
        return local.select(*by, "_i", F.col("_la").alias("_pa"), F.col("_lb").alias("_pb"))
    outer = _composed(t.select(*by, F.col("_g").alias("_i"), F.col("_f.a").alias("_a"), F.col("_f.b").alias("_b")), by, size, levels - 1)
    both = join_null_safe(local, outer.withColumnRenamed("_i", "_g"), [*by, "_g"])
    return both.select(*by, "_i", (F.col("_la") * F.col("_pa")).alias("_pa"), (F.col("_la") * F.col("_pb") + F.col("_lb")).alias("_pb"))


def ema(df: DataFrame, by: Sequence[str], step: str, value: str, out: str,
        alpha: float, bucket_rows: int | None = None, group: int = 512, levels: int = 2) -> DataFrame:
    """Exponential moving average ``e1 = v1, e = a*v + (1-a)*e`` per group.

    ``step`` must be dense 1..n within a group. One step is the affine map
    ``x -> d x + a v`` (``d = 1 - a``), and maps compose associatively. Inside
    a bucket of B rows the composition's constant part is
    ``a * d^i * sum_{j<=i} v_j d^-j``, a native running sum; B is chosen so
    ``d^-B`` stays far from overflow. The buckets' maps ``(d^len, last)`` are
    composed in groups of ``group``, those in groups again, ``levels`` times,
    which gives the exact carry into every bucket: no history is dropped, and
    no task sees all buckets of a run before they number less than
    ``rows / (B * group ** levels)``. A null value counts as zero.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    d, by = 1.0 - alpha, list(by)
    if d == 0:
        return df.withColumn(out, F.col(value).cast("double"))
    ln_d = math.log(d)
    size = max(1, min(bucket_rows or (1 << 16), int(600.0 / -ln_d)))
    s0 = F.col(step) - 1
    b = F.floor(s0 / size).cast("long")
    t = df.withColumn("_eb", b).withColumn("_ep", s0 - F.col("_eb") * size)
    w = (Window.partitionBy(*by, "_eb").orderBy(step)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    t = t.withColumn("_loc", F.lit(alpha) * F.exp(F.col("_ep") * F.lit(ln_d)) * F.sum(v * F.exp(-F.col("_ep") * F.lit(ln_d))).over(w))
    maps = t.groupBy(*by, F.col("_eb").alias("_i")).agg(
        F.exp(F.count(F.lit(1)) * F.lit(ln_d)).alias("_a"), F.max_by("_loc", "_ep").alias("_b"))
    first = t.filter(F.col(step) == 1).select(*by, v.alias("_v0"))
    carry = join_null_safe(_composed(maps, by, group, levels), first, by)
    carry = carry.select(*by, F.col("_i").alias("_eb"), (F.col("_pa") * F.col("_v0") + F.col("_pb")).alias("_carry"))
    res = join_null_safe(t, carry, [*by, "_eb"]).withColumn(
        out, F.col("_loc") + F.exp((F.col("_ep") + 1) * F.lit(ln_d)) * F.col("_carry"))
    return res.drop("_eb", "_ep", "_loc", "_carry")
