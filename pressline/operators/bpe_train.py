"""Learning byte-level BPE merges, hundreds of them to a job.

The words are counted once (``bpe.word_histogram``); what is trained on is the
table of distinct words, which grows with the vocabulary of the corpus and
never comes to the driver. One epoch learns many merges exactly:

1. Spark counts all adjacent pairs of the word table and ranks them by (count
   descending, left id, right id). The first ``CANDIDATES`` are the candidates;
   the last of them is the epoch's cut-off.
2. Every maximal run of symbols in which each adjacent pair is a candidate is a
   segment. Spark counts the distinct segments, a table that is small because
   the same few frequent pairs make them up; with more than ``SEGMENTS`` of them
   the epoch goes on with fewer candidates.
3. The driver merges inside the segments, best pair first, with an inverted
   index pair -> segments, so that a merge touches only the segments that hold
   it and counts change only by them. It stops before a pair that ranks behind
   the cut-off.
4. The tasks put the merged segments in the place of the old ones and write the
   word table for the next epoch.

That gives the merges of one-at-a-time training. All occurrences of a candidate
lie in segments, so counts are exact. A pair that arises across the border of a
segment stands where a pair that was no candidate stood: its count is not above
that one's, hence not above the cut-off's; on equal counts its left id is not
below that pair's and its right id above it, or its left id is new and the
largest, so it ranks behind the cut-off too. One thing could break this: a
merge whose string is already a token (the token's id is used again, and its
older pairs may gain). Such a merge is the last of its epoch.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.functions.bytes_ import byte_ids
from pressline.operators.bpe import BpeModel, tasks
from pressline.session import materialize_table

PAIR_SHIFT = 1 << 32
#: pairs ranked per epoch, and distinct segments that the driver takes at most
CANDIDATES, SEGMENTS = 4096, 1 << 18


def _symbols(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch of words laid end to end, and each one's word."""
    col = b.column("sym")
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.repeat(np.arange(len(n)), n)


def _pairs(sym: np.ndarray) -> np.ndarray:
    return sym[:-1].astype(np.int64) * PAIR_SHIFT + sym[1:]


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, cnt): adjacent pairs of all words, counted per batch first, so
    that the shuffle carries one row per pair and batch."""
    def run(batches):
        for b in batches:
            sym, word = _symbols(b)
            same = word[:-1] == word[1:]
            pair, weight = _pairs(sym)[same], b.column("freq").to_numpy()[word[:-1][same]]
            if len(pair):
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[order][first]), pa.array(np.add.reduceat(weight[order], first))], names=["key", "cnt"])

    tot = words.mapInArrow(run, "key long, cnt long").groupBy("key").agg(F.sum("cnt").alias("cnt"))
    return tot.select(F.shiftright("key", 32).cast("int").alias("l"), (F.col("key") % F.lit(PAIR_SHIFT)).cast("int").alias("r"), "cnt")


def _runs(sym: np.ndarray, word: np.ndarray, keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of symbols joined by pairs of ``keys``."""
    if len(sym) < 2:
        return [], []
    pair = _pairs(sym)
    hit = (keys[np.minimum(np.searchsorted(keys, pair), len(keys) - 1)] == pair) & (word[:-1] == word[1:])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist()


def segment_counts(words: DataFrame, keys: np.ndarray) -> DataFrame:
    """(seg, freq): the distinct segments, as 4-byte ids, with their words' counts."""
    def run(batches):
        for b in batches:
            sym, word = _symbols(b)
            starts, ends = _runs(sym, word, keys)
            raw, freq, count = sym.tobytes(), b.column("freq").to_numpy()[word[starts]].tolist() if starts else [], defaultdict(int)
            for s, e, f in zip(starts, ends, freq, strict=True):
                count[raw[4 * s:4 * e]] += f
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                                             names=["seg", "freq"])

    return words.mapInArrow(run, "seg binary, freq long").groupBy("seg").agg(F.sum("freq").alias("freq"))


def replace_segments(words: DataFrame, keys: np.ndarray, merged: dict[bytes, bytes]) -> DataFrame:
    """The word table with the ``merged`` segments in place, without the words
    that have become one symbol."""
    def run(batches):
        for b in batches:
            sym, word = _symbols(b)
            starts, ends = _runs(sym, word, keys)
            raw, stay = sym.tobytes(), np.ones(len(sym), bool)
            sym = sym.copy()
            for s, e in zip(starts, ends, strict=True):
                new = merged.get(raw[4 * s:4 * e])
                if new is not None:
                    k = len(new) // 4
                    sym[s:s + k] = np.frombuffer(new, np.int32)
                    stay[s + k:e] = False
            sym, word = sym[stay], word[stay]
            n = np.bincount(word, minlength=b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(sym))
            open_ = pa.array(n > 1)
            yield pa.RecordBatch.from_arrays([b.column("freq").filter(open_), lists.filter(open_)], names=["freq", "sym"])

    return words.mapInArrow(run, "freq long, sym array<int>")


def _merge(seg: list[int], left: int, right: int, new: int) -> list[int]:
    """Every occurrence of the pair, from the left, without overlaps."""
    out, i, n = [], 0, len(seg)
    while i < n:
        if i + 1 < n and seg[i] == left and seg[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(seg[i])
            i += 1
    return out


def learn(model: BpeModel, segments: list[tuple[bytes, int]], vocab_size: int, cutoff: tuple[int, int, int]) -> dict[bytes, bytes]:
    """Adds an epoch's merges to ``model`` and returns the segments they change.
    ``cutoff``: (-count, left, right) of the last pair that may be taken."""
    segs = [np.frombuffer(s, np.int32).tolist() for s, _ in segments]
    freq = [f for _, f in segments]
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, s in enumerate(segs):
        for p in zip(s, s[1:]):
            count[p] += freq[i]
            where[p].add(i)
    heap = [(-c, *p) for p, c in count.items()]
    heapq.heapify(heap)
    known = {t: i for i, t in enumerate(model.tokens)}
    changed: set[int] = set()
    while heap and len(model.tokens) < vocab_size:
        top = heapq.heappop(heap)
        left, right = pair = top[1:]
        now = count.get(pair, 0)
        if now != -top[0]:
            if 0 < now < -top[0]:
                heapq.heappush(heap, (-now, left, right))
            continue
        if top > cutoff:
            break
        string = model.tokens[left] + model.tokens[right]
        new = known.get(string)
        again = new is not None
        if not again:
            new = known[string] = len(model.tokens)
            model.tokens.append(string)
        model.merges.append((left, right, new))
        grown = set()
        for i in where.pop(pair):
            old, f = segs[i], freq[i]
            for p in zip(old, old[1:]):
                count[p] -= f
                where[p].discard(i)
            segs[i] = now = _merge(old, left, right, new)
            for p in zip(now, now[1:]):
                count[p] += f
                where[p].add(i)
                if new in p:
                    grown.add(p)
            changed.add(i)
        for p in grown:
            heapq.heappush(heap, (-count[p], *p))
        if again:
            break
    return {segments[i][0]: np.array(segs[i], np.int32).tobytes() for i in changed}


def train_bpe(hist: DataFrame, vocab_size: int, candidates: int = CANDIDATES, most_segments: int = SEGMENTS) -> BpeModel:
    """Merges of a (word, freq) table until the vocabulary has ``vocab_size``
    entries (specials, 256-symbol alphabet, then merges in learning order) or
    no pair is left. ``rounds`` of the model are its epochs.

    The word table is written under the shared checkpoint folder once an epoch,
    so a lost executor costs a re-read. The driver holds the model, at most
    ``candidates`` pairs and ``most_segments`` segments."""
    model = BpeModel.base()
    words = hist.select(F.col("freq").cast("long").alias("freq"), byte_ids(F.col("word")).alias("sym"))
    words = materialize_table(words.filter(F.size("sym") > 1).repartition(tasks(words)), "bpe-words")
    k = candidates
    while len(model.tokens) < vocab_size:
        k = min(k, 2 * (vocab_size - len(model.tokens)) + 16)
        ranked = pair_counts(words).orderBy(F.col("cnt").desc(), "l", "r").limit(k).collect()
        if not ranked:
            break
        whole = len(ranked) < k
        while True:
            keys = np.sort(np.array([r["l"] * PAIR_SHIFT + r["r"] for r in ranked], np.int64))
            segments = segment_counts(words, keys).limit(most_segments + 1).collect()
            if len(segments) <= most_segments or len(ranked) == 1:
                break
            ranked, whole = ranked[:max(1, len(ranked) // 4)], False
        k = min(candidates, max(k if whole else 2 * len(ranked), 16))
        last = ranked[-1]
        cutoff = (0, 0, 0) if whole else (-last["cnt"], last["l"], last["r"])
        merged = learn(model, [(bytes(r["seg"]), r["freq"]) for r in segments], vocab_size, cutoff)
        model.rounds += 1
        if len(model.tokens) < vocab_size:
            words = materialize_table(replace_segments(words, keys, merged), "bpe-words")
    return model
