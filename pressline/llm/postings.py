"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced bisection of a bounded sample. Every distinct
vector goes to its nearest list and, near a boundary, to further ones; a query
searches the centroids through a neighbour graph in memory and reads the lists
within a distance ratio of the nearest. Copies are one entry with their least
ids, which is all that any result can hold of them. Neighbouring lists share
a shelf, the unit of work; long shelves and shelves that many queries read are
dealt to several tasks by salts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: vectors that the centroids are fitted on, at most
SAMPLE = 20_000
LIST_SIZE, MAX_LISTS = 100, 1024
REPLICAS, REPLICA_RATIO, SEARCH_RATIO = 4, 1.4, 1.5
DEGREE, ENTRIES = 16, 8
#: neighbouring lists stand on one shelf, so that a query goes to a task once for all of them
SHELVES = 32
#: entries and queries of a shelf that one task holds, about
BLOCK = 8192
#: cosines of unit vectors that are nearer than this are told apart by the exact measure only
TIE = 1e-9


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Float64 values and offsets of a list column; null lists are empty, null components nan."""
    col = col.cast(pa.large_list(pa.float64()))
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False) if len(col.values) else np.zeros(0)
    count = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(off))
    return flat, np.stack([off[:-1], off[:-1] + count], 1)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), -1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v binary): rows with a non-null id and a finite, non-zero vector,
    as little-endian doubles."""
    def run(batches):
        for b in batches:
            flat, at = _rows(b.column(1))
            ok, raw = [], []
            for i, (a, e) in enumerate(at.tolist()):
                x = flat[a:e]
                if len(x) and np.isfinite(x).all() and x.any():
                    ok.append(i)
                    raw.append((x + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), pa.array(raw, pa.binary())], names=["id", "v"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(run, f"id {kind}, v binary")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of about ``lists`` cells that hold equally many of the
    unit rows ``x``: cells are halved at the median between two means."""
    rng, cells = np.random.default_rng(3), [np.arange(len(x))]
    while len(cells) < lists:
        out = []
        for ix in cells:
            if len(ix) < 4:
                out.append(ix)
                continue
            y = x[ix]
            c = y[rng.choice(len(ix), 2, replace=False)]
            for _ in range(6):
                side = y @ (c[0] - c[1])
                a = np.zeros(len(ix), bool)
                a[np.argsort(side, kind="stable")[len(ix) // 2:]] = True
                c = np.stack([y[a].mean(0), y[~a].mean(0)])
            out += [ix[a], ix[~a]]
        if len(out) == len(cells):
            break
        cells = out
    c = np.stack([x[ix].mean(0) for ix in cells])
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)


class Graph:
    """Centroids in memory with their nearest neighbours linked both ways."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        near = np.argsort(-(centroids @ centroids.T), 1, kind="stable")[:, 1:DEGREE + 1]
        links = [set(r) for r in near.tolist()]
        for i, r in enumerate(near.tolist()):
            for j in r:
                links[j].add(i)
        self.links = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(links)]
        self.entries = np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids found within ``ratio`` times the least distance 1 - cosine."""
        d = np.full(len(self.c), np.inf)
        done = np.zeros(len(self.c), bool)
        d[self.entries] = 1 - self.c[self.entries] @ q
        while True:
            least = max(d.min(), 1e-12)
            front = np.flatnonzero(~done & (d <= ratio * least))
            if not len(front):
                if done[d.argmin()]:
                    return np.flatnonzero(d <= ratio * least)
                front = np.array([d.argmin()])
            done[front] = True
            new = np.unique(np.concatenate([self.links[i] for i in front])) if len(self.c) > 1 else front
            new = new[np.isinf(d[new])]
            d[new] = 1 - self.c[new] @ q


def search(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score double): the k nearest found of every
    row for which ``queries`` (a condition on column id) holds.

    Nearness is the cosine in doubles of the vectors as given; ties go to the
    smaller id. A row with a null id or a vector that is null, empty, zero or
    holds a null or non-finite component takes no part, nor one whose length
    is not the most frequent one. Exact repeats of a row are one row; rows
    with one id and different vectors are all left out of that id's results.
    Extra columns are not read. With fewer candidates all are returned."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors, key, vector).distinct(), "vectors")
    length = rows.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.length("v") == (length[0].n if length else 0))
    # of copies, the least k + 1 ids and those of queries matter: a query may hold one of them itself
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(classes.select("v", "ids", F.element_at("ids", 1).alias("rep")), "classes")
    asked = cut(rows.where(queries).join(classes.select("v", "rep"), "v").select("id", "rep"), "asked")
    probes = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")

    distinct = classes.count()
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    lists = int(np.clip(distinct // LIST_SIZE, 1, MAX_LISTS))
    centroids = balanced_centroids(unit(_matrix(sample)), lists) if len(sample) else np.ones((1, 1))
    graph = spark.sparkContext.broadcast(Graph(centroids))
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                d = 1 - unit(_matrix(part.column(1))) @ graph.value.c.T
                n = min(REPLICAS, d.shape[1])
                near = np.argpartition(d, n - 1, 1)[:, :n]
                dist = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(dist <= REPLICA_RATIO * np.maximum(dist.min(1, keepdims=True), 1e-12))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                                  pa.array(near[row, col].astype(np.int32))], names=["rep", "v", "list"])

    def ask(batches):
        shelf_of = np.arange(len(centroids)) * SHELVES // len(centroids)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                row, shelf, wanted = [], [], []
                for r, q in enumerate(unit(_matrix(part.column(1)))):
                    got = graph.value.search(q, SEARCH_RATIO)
                    for s in np.unique(shelf_of[got]).tolist():
                        row.append(r)
                        shelf.append(s)
                        wanted.append(got[shelf_of[got] == s].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                                  pa.array(shelf, pa.int32()), pa.array(wanted, pa.list_(pa.int32()))],
                                                 names=["rep", "v", "shelf", "lists"])

    posted = cut(classes.select("rep", "v").mapInArrow(place, f"rep {kind}, v binary, list int"), "postings")
    posted = posted.withColumn("shelf", F.floor(F.col("list") * SHELVES / len(centroids)).cast("int"))
    asking = cut(probes.mapInArrow(ask, f"rep {kind}, v binary, shelf int, lists array<int>"), "probes")
    # salts: a shelf is cut into blocks of about BLOCK entries, its queries likewise
    p = posted.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p_blocks"))
    a = asking.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    blocks = cut(p.join(a, "shelf"), "blocks")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(blocks, "shelf").select("shelf", deal("p_blocks").alias("pb"), every("q_blocks").alias("qb"), "rep", "v", "list")
    right = asking.join(blocks, "shelf").select("shelf", every("p_blocks").alias("pb"), deal("q_blocks").alias("qb"), "rep", "v", "lists")
    out_type = f"query {kind}, rep {kind}, score double"
    most = k + 1

    def meet(entries: pa.Table, asked_: pa.Table) -> pa.Table:
        ids, qids = entries.column("rep").combine_chunks(), asked_.column("rep").combine_chunks()
        rows, cands, scores = [], [], []
        if len(ids) and len(qids):
            # a vector may stand in several lists of the shelf: one row with all of them
            raw = entries.column("rep").to_numpy()
            _, one, entry = np.unique(raw, return_index=True, return_inverse=True)
            x = _matrix(entries.column("v").combine_chunks().take(pa.array(one)))
            lists_ = entries.column("list").to_numpy()
            number = {v: n for n, v in enumerate(np.unique(lists_).tolist())}
            holds = np.zeros((len(one), len(number)), np.float32)
            holds[entry, [number[v] for v in lists_.tolist()]] = 1
            xu, q = unit(x), _matrix(asked_.column("v").combine_chunks())
            wanted = asked_.column("lists").to_pylist()
            for i in range(0, len(q), 256):
                reads = np.zeros((len(q[i:i + 256]), len(number)), np.float32)
                for r, w in enumerate(wanted[i:i + 256]):
                    reads[r, [number[v] for v in w if v in number]] = 1
                near = np.where(reads @ holds.T > 0, unit(q[i:i + 256]) @ xu.T, -np.inf)
                n = min(most, len(x))
                # all that may be among the best: rounding moves a product by far less than TIE
                least = -np.partition(-near, n - 1, 1)[:, n - 1] - TIE
                row, col = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                score = np.concatenate([np.zeros(0), *(_cosine(q[row[j:j + BLOCK] + i], x[col[j:j + BLOCK]]) for j in range(0, len(row), BLOCK))])
                order = np.lexsort((raw[one][col], -score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.searchsorted(row, row)
                best = np.arange(len(row)) - first < most
                rows.append(row[best] + i)
                cands.append(col[best])
                scores.append(score[best])
        if not rows:
            return pa.table({"query": qids.slice(0, 0), "rep": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table({"query": qids.take(pa.array(np.concatenate(rows))), "rep": ids.take(pa.array(one[np.concatenate(cands)])),
                         "score": pa.array(np.concatenate(scores))})

    group = ["shelf", "pb", "qb"]
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, out_type)
    met = met.groupBy("query", "rep").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    met = cut(met.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n"), "nearest")
    found = met.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    least = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n")
    final = asked.join(found, asked["rep"] == found["query"]).where("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that a pair's value doesn't depend on what stands around it."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
