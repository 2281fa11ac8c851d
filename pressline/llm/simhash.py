"""SimHash near-duplicates by multi-index hashing.

Every distinct fingerprint stands in one table per 32-bit segment. Two
fingerprints with d <= 2 differing bits have either at most one of them in the
high segment or none in the low one, so probing the high table with the ball
of radius 1 and the low table with the exact value finds every pair; each
match is verified on all 64 bits. Of a pair that differs in one high bit only
the side where it is set probes, which halves the ball.

A segment value shared by more than HOT_BUCKET distinct fingerprints is not
matched pair by pair: everything that stands in such a bucket or probes it
emits its 65 keys at distance <= 1 instead, and fingerprints that share a key
are linked through it. Two fingerprints share one exactly when they differ in
at most two bits, so no link is lost or added, and the work per fingerprint is
constant however large the group.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text
from .components import components

SHINGLE, MAX_BITS = 3, 2
HOT_BUCKET = 64

_LANES = np.uint64(0x0000000100000001)
_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def _shingle_hashes(raw: bytes, k: int) -> list[int]:
    w = raw.lower().split()
    if len(w) <= k:
        return [_xxh(b" ".join(w))] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begin = [0, *(ends[:len(w) - k] + 1).tolist()]
    return [_xxh(joined[a:b]) for a, b in zip(begin, ends[k - 1:].tolist(), strict=True)]


def fingerprints(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> dict[str, np.ndarray]:
    """64-bit SimHash per text; a bit is set if over half the shingles have it."""
    raw, out = buf.tobytes(), np.zeros(len(off) - 1, np.uint64)
    each = [_shingle_hashes(raw[a:b], k) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    count = np.fromiter(map(len, each), np.int64, len(each))
    full = np.flatnonzero(count)
    if len(full):
        h = np.fromiter((x for e in each for x in e), np.uint64, int(count.sum()))
        at, n = np.append(0, np.cumsum(count[full])[:-1]), count[full].astype(np.uint64)
        bits = np.zeros(len(full), np.uint64)
        for b in range(32):  # bits b and b + 32 are counted in two lanes of one word
            s = np.add.reduceat((h >> np.uint64(b)) & _LANES, at)
            low, high = s & np.uint64(0xFFFFFFFF), s >> np.uint64(32)
            bits |= (np.uint64(2) * low > n).astype(np.uint64) << np.uint64(b)
            bits |= (np.uint64(2) * high > n).astype(np.uint64) << np.uint64(b + 32)
        out[full] = bits
    return {"fp": out.view(np.int64)}


def _near_pairs(distinct: DataFrame) -> DataFrame:
    """(u, v) pairs of distinct fingerprints (column fp) at most MAX_BITS apart,
    or links through a shared key where a bucket is hot. Connectivity is that
    of all pairs."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    entries = distinct.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("val")),
        F.struct(F.lit(1).alias("seg"), low.alias("val")))).alias("e")).select("fp", "e.seg", "e.val")
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.struct(
        F.lit(0).alias("seg"), high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("val")))
    # a flip that clears a set bit makes the value smaller
    balls = F.filter(flips, lambda x: x["val"] < high)
    exact = F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")),
                    F.struct(F.lit(1).alias("seg"), low.alias("val")))
    probes = distinct.select("fp", F.explode(F.concat(exact, balls)).alias("p")).select("fp", "p.seg", "p.val")
    hot = cut(entries.groupBy("seg", "val").count().where(F.col("count") > HOT_BUCKET).select("seg", "val"), "hot")

    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    mild = entries.join(hot, ["seg", "val"], "left_anti").withColumnRenamed("fp", "other")
    same = (F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", 32) == F.shiftrightunsigned("other", 32))
            .otherwise(F.lit(True)))
    pairs = (probes.join(mild, ["seg", "val"])
             .where((apart <= MAX_BITS) & (~same | (F.col("fp") < F.col("other"))) & (F.col("fp") != F.col("other")))
             .select(F.col("fp").alias("u"), F.col("other").alias("v")))

    crowd = probes.join(hot, ["seg", "val"], "left_semi").select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    keys = crowd.select("fp", F.explode(ball).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    through = keys.join(least, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(through)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long, root long, component_id): one row per row of ``docs``.

    ``fp`` is the fingerprint, ``root`` names the component, ``component_id``
    is the least key in it. Texts that are null, empty or blank have
    fingerprint zero and link like any other. Repeated rows and rows that
    share a key keep a row each; a null key is never the least unless the
    whole component has null keys. Extra columns are not read."""
    marks = cut(map_text(docs, fingerprints, "fp long", (key,), text), "fingerprints")
    edges = _near_pairs(marks.select("fp").distinct())
    roots = components(edges)
    classes = marks.groupBy("fp").agg(F.min(key).alias("least"))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.drop("least").join(ids, "root")
    return marks.join(named, "fp").select(key, "fp", "root", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every group of near-duplicates the row with the least key (then the
    least fingerprint); all columns as they were. Exact repeats of a row are
    one document."""
    found = cut(near_duplicates(docs, key, text), "near")
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("fp"))
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    if found.groupBy(key).count().where("count > 1").limit(1).count():
        # keys that repeat: rows are told apart by their fingerprint, then by the text
        rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
        marks = map_text(rows, fingerprints, "fp long", ("row", "key"))
        chosen = marks.join(best.select(F.col("best.k").alias("k"), F.col("best.fp").alias("fp")).distinct(), "fp")
        chosen = chosen.where(F.col("key").eqNullSafe(F.col("k")))
        least = F.struct(F.col("row").getField(text), F.to_json("row"))
        return chosen.groupBy("key", "fp").agg(F.min_by("row", least).alias("row")).select("row.*")
    gone = found.join(best, "root").where(~(F.col(key).eqNullSafe(F.col("best.k")) & (F.col("fp") == F.col("best.fp"))))
    gone = gone.select(F.col(key).alias("gone"))
    return docs.join(gone, docs[key].eqNullSafe(gone["gone"]), "left_anti")
