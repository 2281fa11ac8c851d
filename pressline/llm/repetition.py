"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over the words of a whole text mark
every n-gram that occurs before in the same text; the characters inside those
repeats, and inside repeated lines, are measured against all characters of
words. Of short n-grams, which every text repeats, the one with the most
characters in its occurrences is measured. Everything is computed inside the
task that holds the text: no shuffle, no key, so copies and hot sources cost
nothing extra.

The limits were read off `labels` at scale 0.1. Of 3 302 documents of quality 1
that pass the base rule, the largest share in repeats of 5- to 10-grams is
0.138, in repeated lines 0.138 of the characters and 0.333 of the lines; the
limits stand just above. The limits of 2- to 4-grams are those of published
rules for web text; 2 of the 3 302 are above, their largest 2-, 3- and 4-gram
shares being 0.219, 0.244 and 0.147.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text, spans_of, text_bytes
from .textbatch import byte_codes, mix, per_text, rolling, window, words

#: n-gram length -> largest share of characters in repeats that a kept text may have
NGRAM_LIMITS = {5: 0.15, 6: 0.15, 7: 0.15, 8: 0.15, 9: 0.15, 10: 0.15}
#: n-gram length -> largest share of characters in the occurrences of one n-gram
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: largest shares of characters in repeated lines, and of lines that are repeats, the latter in texts of MIN_LINES lines or more
LINE_LIMIT, LINE_COUNT_LIMIT, MIN_LINES = 0.20, 0.35, 10
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double, top_ngram_share double")


def _seen(keys: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks keys found twice or more; with ``later_only`` not the first of each."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    hit = np.zeros(len(keys), bool)
    if len(twice):
        at = np.searchsorted(twice, keys)
        at[at == len(twice)] = 0
        hit = twice[at] == keys
        if later_only:
            where = np.flatnonzero(hit)
            _, first = np.unique(keys[where], return_index=True)
            hit[where[first]] = False
    return hit


def _covered(hit: np.ndarray, begin: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the words inside the hit windows of length n."""
    d = np.zeros(total + 1, np.int64)
    at = begin[hit]
    np.add.at(d, at, 1)
    np.add.at(d, at + n, -1)
    return np.cumsum(d[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a chunk of texts."""
    texts = len(off) - 1
    starts, ends, first = words(buf, off)
    n_words = np.diff(first)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    size = chars[ends] - chars[starts]
    word_chars = per_text(size, first)
    salt = mix(np.arange(1, texts + 1, dtype=np.uint64))
    state = rolling(byte_codes(False)[buf])
    doc = np.repeat(np.arange(texts), n_words)

    # lines: from a text's start or behind a line feed to the next one or the text's end
    cuts = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1], cuts + 1]))
    line_end = np.append(line_start[1:], len(buf))
    line_end = line_end - ((line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 10) if len(buf) else 0)
    lo, hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    real = hi > lo
    line_start, line_end, lo, hi = line_start[real], line_end[real], lo[real], hi[real]
    line_doc = doc[lo]
    again = _seen(window(state, line_start, line_end) ^ salt[line_doc], True)
    n_dup_lines = np.bincount(line_doc[again], minlength=texts)
    cum = np.append(0, np.cumsum(size))
    dup_chars = np.bincount(line_doc[again], weights=(cum[hi] - cum[lo])[again], minlength=texts)

    n_lines = np.bincount(line_doc, minlength=texts)

    grams = rolling(window(state, starts, ends))
    room = first[1:][doc] - np.arange(len(starts))
    worst, bad, n_repeat = np.zeros(texts), np.zeros(texts, bool), np.zeros(texts, np.int64)
    some = np.maximum(word_chars, 1)
    for n, limit in NGRAM_LIMITS.items():
        begin = np.flatnonzero(room >= n)
        keys = window(grams, begin, begin + n) ^ salt[doc[begin]]
        if n == BASE_WINDOW:
            n_repeat = per_text(_covered(_seen(keys, False), begin, n, len(starts)), first)
        share = per_text(size * _covered(_seen(keys, True), begin, n, len(starts)), first) / some
        worst, bad = np.maximum(worst, share), bad | (share > limit)
    top = np.zeros(texts)
    for n, limit in TOP_LIMITS.items():
        begin = np.flatnonzero(room >= n)
        _, at, times = np.unique(window(grams, begin, begin + n) ^ salt[doc[begin]], return_index=True, return_counts=True)
        at, times = begin[at[times > 1]], times[times > 1]
        share = np.zeros(texts)
        np.maximum.at(share, doc[at], times * (cum[at + n] - cum[at]))
        top, bad = np.maximum(top, share / some), bad | (share / some > limit)
    lines = dup_chars / some
    bad |= (n_lines >= MIN_LINES) & (n_dup_lines > LINE_COUNT_LIMIT * n_lines)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
    return {"n_words": n_words.astype(np.int64), "word_chars": word_chars,
            "n_symbols": per_text(_SYMBOL[buf], off), "n_dup_lines": n_dup_lines.astype(np.int64),
            "n_repeat_words": n_repeat, "base_failed": base,
            "kept": ~base & ~bad & (lines <= LINE_LIMIT),
            "dup_line_share": lines, "dup_ngram_share": worst, "top_ngram_share": top}


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and the columns of SCHEMA.

    A null or empty text has no words and fails the base rule. Words compare
    as written (case counts). Repeated rows and null keys give a row each;
    further columns of ``docs`` are not read. An empty table gives no rows.
    """
    return map_text(docs, measure, SCHEMA, (key,), text)


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns as they were."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(at))
            kept = [measure(buf[off[i]:off[j]], off[i:j + 1] - off[i])["kept"] for i, j in spans_of(off)]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
