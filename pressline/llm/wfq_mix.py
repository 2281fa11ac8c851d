"""Mixing sources to target weights by weighted fair queueing, native.

The documents of a source are shuffled by a hash of their key; each gets the
virtual finish time (tokens of its source up to and with it) / (target of the
source), a second and third copy the times that follow. Sorted by that time,
all sources advance in proportion to their targets; the mix is the prefix of
that order that fits the total budget.

Running totals are taken in two levels: rows fall into buckets by their
shuffle hash (a bucket count that grows with the table), the buckets' totals
are summed up, and a window runs inside each (source, bucket) only. A source
with a third of all rows is spread over as many tasks as its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_REPEATS = 3
#: rows in a bucket of a running total, about
BUCKET_ROWS = 8192
#: slices of virtual time per round of the search for the cut
TIME_SLICES = 1024

_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, size) -> (source, source_size, target), one row per source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, unless
    ``weights`` gives an integer expression over source and place (from 0).
    All sizes together are shared by weight; a target stops at
    ``max_repeats`` times its source's size and the excess is shared on among
    the others: target = min(cap, weight * level), where the level is found by
    one pass over the sources sorted by cap / weight. The windows run over one
    row per source, a table whose size is the number of sources, not of rows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("place", place)
    s = s.withColumn("weight", (F.pmod("place", F.lit(3)) + 1 if weights is None else weights).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(whole))
         .withColumn("caps_before", F.sum("cap").over(by.rowsBetween(*_RUNNING)) - F.col("cap"))
         .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(by.rowsBetween(*_RUNNING)) + F.col("weight")))
    full = F.col("cap") * F.col("weight_left") <= (F.col("total") - F.col("caps_before")) * F.col("weight")
    # the first source that is not full fixes the level for itself and all behind it
    level = F.struct("place_by", "left", "weight_left")
    s = s.withColumn("place_by", F.row_number().over(by)).withColumn("left", F.col("total") - F.col("caps_before"))
    s = s.withColumn("first", F.min(F.when(~full, level)).over(whole))
    target = F.when(F.col("first").isNull() | (F.col("place_by") < F.col("first.place_by")), F.col("cap").cast("double")).otherwise(
        F.col("left_first") * F.col("weight") / F.col("weight_first"))
    s = s.withColumn("left_first", F.col("first.left")).withColumn("weight_first", F.col("first.weight_left"))
    return s.select("source", "source_size", target.alias("target"))


def _finish(copy: int) -> Column:
    """Virtual finish time of a copy; none where there is no target."""
    return (F.col("source_size") * copy + F.col("cum")) / F.when(F.col("target") > 0, F.col("target"))


def _cut_time(run: DataFrame, max_repeats: int) -> float:
    """The last virtual time at which the sorted mix still fits the budget.

    All that ends by time 1 fits, as the targets add up to the budget. Behind
    that, totals per slice of time say in which slice the budget ends; that
    slice, from its first to its last time, is cut up again until one point in
    time is left. First and last never share a slice of the next round, so
    every round ends nearer. At most TIME_SLICES rows a round come to the
    driver, and no round sorts the table."""
    copies = [F.struct(_finish(c).alias("t"), F.lit(c).alias("copy")) for c in range(max_repeats)]
    timed = run.select("size", F.explode(F.array(*copies)).alias("c")).select("size", "c.t", "c.copy").where("size > 0")
    row = timed.agg(F.sum(F.when(F.col("copy") == 0, F.col("size"))), F.sum(F.when(F.col("t") <= 1, F.col("size"))),
                    F.max("t")).first()
    rest, lo, hi, fits = (row[0] or 0) - (row[1] or 0), 1.0, row[2] or 1.0, None
    while hi > lo:
        inside = timed.where((F.col("t") > lo) & (F.col("t") <= hi))
        at = F.ceil((F.col("t") - lo) / (hi - lo) * TIME_SLICES)
        slices = inside.groupBy(at.alias("at")).agg(F.sum("size"), F.min("t"), F.max("t")).collect()
        fits = lo if fits is None else fits
        for _, size, first, last in sorted(slices):
            if size > rest:
                break
            rest, fits = rest - size, last
        else:
            return fits
        if first == last:
            return fits
        lo, hi = math.nextafter(first, -math.inf), last
    return lo


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source, size, tie, source_size, target, cum, repeats, taken) per row of ``docs``.

    ``cum``: words of the source up to and with the row in shuffle order;
    ``repeats``: copies in the mix; ``taken`` = repeats * size. The shuffle is
    by md5 of the key, then key, size and a hash of the text, so reruns agree;
    exact repeats of a row are interchangeable. Documents that finish at the
    same time are in or out together. Null text has size 0; a row of size 0
    is in the mix once while its source has a target. Null keys take part, the
    null source is one source. An empty table gives no rows."""
    shuffled = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                           shuffled.alias("ord"), F.xxhash64(text).alias("tie")), "mix-sizes")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.shiftrightunsigned(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * buckets, 32))
    parts = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = cut(source_targets(parts.select("source", "size"), max_repeats=max_repeats), "mix-targets")
    before = parts.select("source", "bucket", (F.sum("size").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(*_RUNNING)) - F.col("size")).alias("before"))
    before = before.join(targets, before["source"].eqNullSafe(targets["source"])).select(
        before["source"].alias("_source"), F.col("bucket").alias("_bucket"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("ord", F.col("key").asc_nulls_last(), "size", "tie")
    run = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(*_RUNNING)))
    run = run.join(before, run["source"].eqNullSafe(before["_source"]) & (run["bucket"] == before["_bucket"]))
    run = cut(run.select("key", "source", "size", "tie", "source_size", "target",
                         (F.col("before") + F.col("inside")).alias("cum")), "mix-plan")
    last = _cut_time(run, max_repeats)
    taken = sum((F.when(_finish(c) <= last, 1).otherwise(0) for c in range(max_repeats)), F.lit(0))
    once = F.when(F.col("size") > 0, taken).otherwise(F.when(F.col("target") > 0, 1).otherwise(0))
    return (run.withColumn("repeats", once.cast("int")).withColumn("taken", F.col("repeats") * F.col("size"))
               .withColumnRenamed("key", key).withColumnRenamed("source", source))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``plan`` takes it,
    range-sorted by virtual finish time over the whole table; columns as they
    were."""
    p = plan(docs, key, text, source, max_repeats)
    p = p.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("tie").alias("_tie"), "source_size",
                 "target", "cum", "repeats")
    same = ["_key", "_source", "_tie"]
    # the row travels as one column, so that none of its names can meet one of these
    d = docs.select(F.struct("*").alias("row"), F.col(key).alias("_d_key"), F.col(source).alias("_d_source"), F.xxhash64(text).alias("_d_tie"))
    on = [F.col(f"_d{k}").eqNullSafe(F.col(k)) for k in same]
    if p.groupBy(*same).count().where("count > 1").limit(1).count():  # exact repeats of a row: one to one
        d = d.withColumn("_d_n", F.row_number().over(Window.partitionBy(*[f"_d{k}" for k in same]).orderBy(F.lit(1))))
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("cum")))
        on.append(F.col("_d_n") == F.col("_n"))
    p = p.where("repeats > 0")
    copies = F.transform(F.sequence(F.lit(0), F.col("repeats") - 1),
                         lambda c: (F.col("source_size") * c + F.col("cum")) / F.col("target"))
    mixed = d.join(p, on).withColumn("_time", F.explode(copies))
    return mixed.repartitionByRange("_time").sortWithinPartitions("_time", "_key").select("row.*")
