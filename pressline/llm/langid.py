"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter per language, laid across the bits of one table: the word at
a position has the bit of every language that has set it, so three reads and
two ANDs tell all languages that contain an n-gram at once. Per text the hits
of each language are counted, corrected for the filter's false positives, and
the language with most decides.

The filters are filled from a bounded sample of labelled texts; every text is
then identified whole, where it lies, with the filter as a broadcast of fixed
size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, spans_of, text_bytes
from .textbatch import byte_codes, per_text, rolling, window

NGRAMS = (3, 4, 5)
#: labelled texts that the filters of a language are filled from, about
TEXTS_PER_LANGUAGE = 3000
#: most n-grams of a language, least occurrences, least share of the highest rate among languages
GRAMS_PER_LANGUAGE, LEAST_COUNT, LEAST_SHARE = 30_000, 3, 0.5
SLOT_BITS, PROBES = 20, 3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside a text, and the first one's number per text."""
    folded = _FOLD[buf]
    state = rolling(byte_codes(False)[folded])
    at = np.arange(max(len(buf) - n + 1, 0))
    text_end = np.repeat(off[1:], np.diff(off))[:len(at)]
    at = at[(at + n <= text_end) & (folded[at] + folded[at + n - 1] != 64)]  # one end at least in a word
    return window(state, at, at + n), np.searchsorted(at, off)


def _slots(h: np.ndarray):
    for p in range(PROBES):
        yield (h >> np.uint64(SLOT_BITS * p) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


class Filters:
    """``languages`` in order of their bits, planes of 64 bits, false positive rate each."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = sorted(grams)
        self.planes = np.zeros((max(1, -(-len(self.languages) // 64)), 1 << SLOT_BITS), np.uint64)
        self.wrong = []
        for i, lang in enumerate(self.languages):
            plane, bit = self.planes[i // 64], np.uint64(1) << np.uint64(i % 64)
            for s in _slots(grams[lang].view(np.uint64)):
                plane[s] |= bit
            self.wrong.append(float(np.count_nonzero(plane & bit) / (1 << SLOT_BITS)) ** PROBES)

    def hits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): n-grams that each language contains, corrected."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        for n in NGRAMS:
            h, first = _grams(buf, off, n)
            total = np.diff(first)
            slots = list(_slots(h))
            for p, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for s in slots[1:]:
                    mask &= plane[s]
                for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                    found = per_text((mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool), first)
                    out[:, i] += np.maximum(found - total * self.wrong[i], 0) / (1 - self.wrong[i])
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from ``docs``, which are labelled texts to learn from.

    About TEXTS_PER_LANGUAGE rows of each language are read, chosen by a hash of
    the text and the row's place, so that reruns over the same files agree. An n-gram belongs to a language if it occurs LEAST_COUNT
    times there and at LEAST_SHARE of the highest rate that any language has;
    of those the GRAMS_PER_LANGUAGE most frequent are kept, so what comes to
    the driver is bounded by the number of languages."""
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").count().collect()  # a row per language
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, r["count"])])[F.col("lang")] if sizes else F.lit(0)
    # by text and place, so that copies of one text are drawn one by one
    dice = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where(dice * size < TEXTS_PER_LANGUAGE)

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(0))
            langs = np.array(b.column(1).to_pylist(), object)
            for lang_ in set(langs.tolist()):
                got = []
                for i, j in spans_of(off):
                    for k in np.flatnonzero(langs[i:j] == lang_) + i:
                        piece = buf[off[k]:off[k + 1]]
                        got += [_grams(piece, np.array([0, len(piece)]), n)[0] for n in NGRAMS]
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "h", "n"])

    counts = cut(sample.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("h").agg(F.max("rate").alias("top"))
    own = cut(rates.join(top, "h").where((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_SHARE * F.col("top"))).select("lang", "h", "n"), "own-grams")
    grams = {}
    for (name,) in sorted(own.select("lang").distinct().collect()):  # one language at a time, each bounded
        rows = own.where(F.col("lang") == name).orderBy(F.desc("n"), "h").limit(GRAMS_PER_LANGUAGE).select("h").collect()
        grams[name] = np.array([r.h for r in rows], np.int64)
    return Filters(grams)


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred string, score double): one row per row of ``docs``.

    ``score`` is the chosen language's part of all languages' corrected hits.
    ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned; a text with letters but no hit gets the first language with score
    0. Ties go to the first language by name. Extra columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(buf, off):
        f = shared.value
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        letters = per_text(ascii_letter[buf], off) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, buf[off[i]:off[i + 1]].tobytes().decode()))
        if not f.languages:
            return {"lang_pred": pa.array(["und"] * len(letters)), "score": np.zeros(len(letters))}
        hits = f.hits(buf, off)
        best, total = hits.argmax(1), hits.sum(1)
        names = np.array(f.languages, object)[best]
        names[~letters] = "und"
        score = np.where(letters & (total > 0), hits.max(1) / np.maximum(total, 1e-12), 0.0)
        return {"lang_pred": pa.array(names.tolist(), pa.string()), "score": np.minimum(score, 1.0)}

    return map_text(docs, run, "lang_pred string, score double", (key,), text)
