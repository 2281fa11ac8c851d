"""Ranked lexical search with range-maximum sparse tables.

Postings of the query terms, (document, occurrences), are written once per
document of the whole corpus. Tasks read them in shards of a bounded number of
documents. In a shard every term has its posting list with each document's
impact and a sparse table over the list: the place of the largest impact in
every run of 2^k postings. The largest impact of a term among the documents of
an interval is then two table reads, and the sum over an item's terms bounds
every score in the interval.

An item starts with one interval, the whole shard. The intervals with the
highest bounds are taken off first, a batch at a time; each is split at its
document of maximum impact, which gets its exact score, and the two rest
intervals get bounds of their own. Intervals below the item's tenth score so
far are dropped; when none is left the shard's ten best are exact. The best of
all shards are ranked by Spark, which keeps ten a task before it shuffles.

Within a shard documents stand by their most frequent query term and their
length, so that neighbours have like impacts and intervals tight bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spans_of, text_bytes
from .textbatch import per_text, word_hashes

#: different (item, term) pairs that are searched together; more items are searched in further passes
BLOCK_TERMS = 1 << 19
#: most documents and postings of a shard, and cells of its (term, document) rank table
SHARD_DOCS, SHARD_POSTINGS, RANK_CELLS = 1 << 13, 1 << 19, 1 << 25
#: intervals taken off at once, and (interval, term) cells worked on at once
BATCH, CELLS = 256, 1 << 16

_INSIDE = np.array([c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def term_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of texts laid end to end, A-Z lower-cased,
    and the first term's number per text (texts + 1)."""
    inside, edge = _INSIDE[buf], np.zeros(len(buf) + 1, bool)
    edge[off] = True
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1] | edge[1:len(buf)]
    e[:-1] &= ~inside[1:] | edge[1:len(buf)]
    starts = np.flatnonzero(s)
    return word_hashes(buf, starts, np.flatnonzero(e) + 1, True), np.searchsorted(starts, off)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h): the different terms of every item, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_bytes(b.column(1))
            for i, j in spans_of(off):
                h, first = term_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                row = np.repeat(np.arange(i, j), np.diff(first))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["item_id", "h"])

    kind = items.schema["item_id"].dataType.simpleString()
    return cut(items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, h long").distinct(), "item-terms")


def _items(pairs: DataFrame, block: int, blocks: int) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Ids of a block's items, each one's terms as places in the block's
    vocabulary, and that vocabulary as sorted hashes."""
    rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    terms: dict = {}
    for i, item in enumerate(rows.column("item_id").to_pylist()):
        terms.setdefault(item, []).append(i)
    vocabulary = np.unique(h)
    return list(terms), [np.searchsorted(vocabulary, np.sort(h[at])) for at in terms.values()], vocabulary


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, term, tf) of every row: the number of its terms, and the
    vocabulary's terms in it with their occurrences. A null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_bytes(b.column(1))
            for i, j in spans_of(off):
                h, first = term_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(j - i), np.diff(first))[known]
                key, tf = np.unique(doc * (len(vocabulary) + 1) + at[known], return_counts=True)
                ends = np.searchsorted(key, np.arange(j - i + 1) * (len(vocabulary) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % (len(vocabulary) + 1), tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(per_text(np.ones(len(h), np.int64), first)), *lists],
                                                 names=["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<int>")


def _document_counts(posted: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term stands, added up in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)[:terms]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    out = np.zeros(terms, np.int64)
    if terms:
        for r in posted.select("term").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
            out[r.at] = r.df
    return out


class Shard:
    """Posting lists of a bounded number of documents with their sparse tables."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int) -> None:
        size = len(n)
        # documents by their most frequent term, then by length
        top = np.full(size, -1, np.int64)
        by_tf = np.lexsort((term, tf))
        top[doc[by_tf]] = term[by_tf]
        self.order = np.lexsort((n, top))
        place = np.empty(size, np.int64)
        place[self.order] = np.arange(size)
        at = np.lexsort((place[doc], term))
        self.doc, term, tf = place[doc][at], term[at], tf[at].astype(np.int64)
        m = np.array([100 - 90 + 90 * int(x) * docs // max(1, length) for x in n], np.int64)[self.order]
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        # rank[t, d]: postings of term t before document d
        self.rank = np.zeros((len(weight), size + 1), np.uint16)
        self.rank[term, self.doc + 1] = 1
        np.cumsum(self.rank, axis=1, out=self.rank)
        levels = max(1, int(np.diff(self.first).max(initial=1)).bit_length())
        self.peak = np.empty((levels, len(term)), np.int32)
        self.peak[0] = np.arange(len(term))
        for k in range(1, levels):
            a, half = self.peak[k - 1], 1 << (k - 1)
            b = np.concatenate([a[half:], a[-1:].repeat(min(half, len(a)))])[:len(a)]
            self.peak[k] = np.where(self.impact[b] > self.impact[a], b, a)
        self.log = np.zeros(size + 2, np.int64)
        self.log[2:] = np.log2(np.arange(2, size + 2)).astype(np.int64)

    def bounds(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval of documents the sum over the terms of their
        largest impacts, and the document of the largest of these."""
        t, base = terms[:, None], self.first[terms][:, None]
        a, b = self.rank[t, lo].astype(np.int64), self.rank[t, hi].astype(np.int64)
        k = self.log[b - a]
        some = b > a
        x = self.peak[k, np.where(some, base + a, 0)]
        y = self.peak[k, np.where(some, base + b - (1 << k), 0)]
        ix, iy = self.impact[x], self.impact[y]
        best = np.where(some, np.maximum(ix, iy), 0)
        row, col = best.argmax(axis=0), np.arange(len(lo))
        return best.sum(axis=0), self.doc[np.where(iy > ix, y, x)[row, col]]

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        t, base = terms[:, None], self.first[terms][:, None]
        a = self.rank[t, docs].astype(np.int64)
        some = self.rank[t, docs + 1] > a
        return np.where(some, self.impact[np.where(some, base + a, 0)], 0).sum(axis=0)

    def search(self, terms: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that are among the k best, equal
        scores included, of those with a score of ``floor`` or more."""
        size = len(self.order)
        terms = terms[self.first[terms + 1] > self.first[terms]]
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, found
        lo, hi = np.array([0]), np.array([size])
        bound, split = self.bounds(terms, lo, hi)
        most, take = max(1, CELLS // len(terms)), 8
        while True:
            open_ = bound >= floor
            lo, hi, bound, split = lo[open_], hi[open_], bound[open_], split[open_]
            if not len(lo):
                break
            take = min(2 * take, BATCH, most)
            now = np.argpartition(-bound, take)[:take] if len(lo) > take else np.arange(len(lo))
            exact = self.scores(terms, split[now])
            docs, found = np.concatenate([docs, split[now]]), np.concatenate([found, exact])
            if len(found) >= k:
                floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                docs, found = docs[found >= floor], found[found >= floor]
            left = np.ones(len(lo), bool)
            left[now] = False
            a, b = np.concatenate([lo[now], split[now] + 1]), np.concatenate([split[now], hi[now]])
            a, b = a[b > a], b[b > a]
            new, at = self.bounds(terms, a, b) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            lo, hi = np.concatenate([lo[left], a]), np.concatenate([hi[left], b])
            bound, split = np.concatenate([bound[left], new]), np.concatenate([split[left], at])
        return docs[found >= floor], found[found >= floor]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in runs of at most ``most`` documents and about SHARD_POSTINGS postings."""
    held, docs, entries = [], 0, 0
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
        i = 0
        while i < b.num_rows:
            j = min(b.num_rows, i + most - docs, max(i + 1, int(np.searchsorted(ends, ends[i] + SHARD_POSTINGS - entries, "right")) - 1))
            held.append(b.slice(i, j - i))
            docs, entries, i = docs + j - i, entries + int(ends[j] - ends[i]), j
            if docs >= most or entries >= SHARD_POSTINGS or i < b.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of every item: (item_id, rank, doc_id, score).

    Terms, weights and scores are those of the query's contract. Items that
    share an item_id are one item with the terms of all; an item without
    a term, or none of whose terms stands in a document, has no rows. Rows that
    share a doc_id are documents of their own; a null doc_id comes last among
    equal scores. Documents without a term count nowhere. Empty tables give no
    rows; other columns are not read. Terms are told apart by 64-bit hashes."""
    pairs = item_terms(items)
    blocks = pairs.count() // BLOCK_TERMS + 1
    found = None
    for block in range(blocks):
        ids, terms, vocabulary = _items(pairs, block, blocks)
        posted = cut(postings(docs, vocabulary), "postings")
        best = _best(posted, terms, len(vocabulary), k)
        named = best.join(items.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, item_id {items.schema['item_id'].dataType.simpleString()}"), "q")
        found = named if found is None else found.unionByName(named)
    order = Window.partitionBy("q", "item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _best(posted: DataFrame, terms: list[np.ndarray], size: int, k: int) -> DataFrame:
    """(q, doc_id, score): every shard's best documents of every item."""
    total = posted.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    docs, length = total[0] or 0, total[1] or 0
    df = _document_counts(posted, size)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    most = max(64, min(SHARD_DOCS, RANK_CELLS // max(1, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches, most):
            lists = t.column("term").combine_chunks()
            doc = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            shard = Shard(t.column("n").to_numpy(), doc, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                          t.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False), weight, docs, length)
            ids = t.column("doc_id").combine_chunks()
            for q, own in enumerate(terms):
                place, score = shard.search(own, k)
                if not len(place):
                    continue
                rows = ids.take(pa.array(shard.order[place]))
                top = sorted(zip((-score).tolist(), [(x is None, x) for x in rows.to_pylist()], range(len(place)), strict=True))[:k]
                at = [i for _, _, i in top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), rows.take(pa.array(at)), pa.array(score[at])],
                                                 names=["q", "doc_id", "score"])

    kind = posted.schema["doc_id"].dataType.simpleString()
    return posted.mapInArrow(run, f"q int, doc_id {kind}, score long")
