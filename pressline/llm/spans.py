"""Substring dedup over sliding sentence spans.

A text is cut into sentences; every run of consecutive sentences that is just
long enough (RUN sentences or more and MIN_WORDS words or more, or fewer
sentences, two at least, of ENOUGH words or more, counted on from its first
sentence) is hashed. Equal hashes are joined over the whole corpus;
the run with the least (doc_id, sentence) stays, and the sentences under every
other one are removed. The first of each hash is a pre-aggregated minimum and
the join back may be split where a passage is in very many documents, so a
hot passage is no single task's work.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

RUN, MIN_WORDS = 3, 12
#: two sentences of so many words are a run too
ENOUGH = 16
#: one word in so many ends a piece of a long sentence
CUT = 4
#: a sentence of more words is cut at commas, then at words chosen by their own hash
LONG_SENTENCE = 24

_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+(?=[ \t\r\x0b\x0c\n]|\Z)[ \t\r\x0b\x0c]*|\n|[.!?]+|\Z)")
_CLAUSE = re.compile(rb"[^,;]*(?:[,;]+|\Z)")
_WORD = re.compile(rb"[ \t\r\x0b\x0c]*[^ \t\r\x0b\x0c]+[ \t\r\x0b\x0c]*")


def pieces(raw: bytes) -> tuple[list[bytes], list[int]]:
    """Pieces that give ``raw`` when joined, with their words. A sentence ends
    behind . ! or ? that white space follows, or behind a line feed; a long one
    is cut on by rules that look at its own words only, so that copies are cut
    alike."""
    out, sizes, open_ = [], [], b""
    for m in _SENTENCE.finditer(raw):
        s = open_ + m.group() if open_ else m.group()
        if not s:
            continue
        if s[-1:] in b".!?" and m.end() < len(raw) and raw[m.end():m.end() + 1] != b"\n":
            open_ = s  # a full stop inside a word or number
            continue
        open_ = b""
        n = len(s.split())
        if n <= LONG_SENTENCE:
            out.append(s)
            sizes.append(n)
            continue
        for c in _CLAUSE.findall(s):
            n = len(c.split())
            if n <= LONG_SENTENCE:
                if c:
                    out.append(c)
                    sizes.append(n)
                continue
            part, n = b"", 0
            for w in _WORD.findall(c):
                part += w
                n += 1
                if xxhash.xxh32_intdigest(w.strip().lower()) % CUT == 0:
                    out.append(part)
                    sizes.append(n)
                    part, n = b"", 0
            if part or not c.strip():
                out.append(part or c)
                sizes.append(n)
    if open_:
        out.append(open_)
        sizes.append(len(open_.split()))
    return out, sizes


def sentences(raw: bytes) -> list[bytes]:
    return pieces(raw)[0]


def runs(raw: bytes) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The sentences, and (first, behind last, hash) of every run. A run starts
    at every sentence with a word and takes the fewest sentences that reach
    RUN and MIN_WORDS, or two if they reach ENOUGH; from the end of a text or
    passage the same is done backwards, so that its last sentences belong to a
    run too. The hash is that of the run's words, lower-cased, a space apart."""
    parts, sizes = pieces(raw)
    real = [i for i, n in enumerate(sizes) if n]
    size = np.cumsum([0, *(sizes[i] for i in real)])
    m = len(real)
    if m < 2:
        return parts, []
    at = np.arange(m)
    end = np.maximum(np.searchsorted(size, size[:-1] + MIN_WORDS, "left"), at + RUN)
    begin = np.maximum(np.minimum(np.searchsorted(size, size[1:] - MIN_WORDS, "right") - 1, at + 1 - RUN), -1)
    two = np.flatnonzero(size[2:] - size[:-2] >= ENOUGH)
    end[two] = two + 2
    begin[two + 1] = two
    both = np.concatenate([at[end <= m] * (m + 1) + end[end <= m], begin[begin >= 0] * (m + 1) + (at + 1)[begin >= 0]])
    first, last = np.divmod(np.unique(both), m + 1)
    line = b" ".join(raw.lower().split())
    blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(blank) + 1 != size[-1]:  # a cut inside a word makes two of it
        line = b" ".join(b" ".join(parts[i].lower().split()) for i in real)
        blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start, stop = np.append(0, blank + 1), np.append(blank, len(line))
    digest, low = xxhash.xxh3_64_intdigest, 1 << 63
    return parts, [(real[a], real[b - 1] + 1, digest(line[s:e]) - low) for a, b, s, e in zip(
        first.tolist(), last.tolist(), start[size[first]].tolist(), stop[size[last] - 1].tolist(), strict=True)]


def _texts(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def _names(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """What tells a row of ``docs`` apart: its key, and where keys repeat a hash
    of its text, ``same``, too."""
    names = {"key": F.col(key)}
    if docs.groupBy(key).count().where("count > 1").limit(1).count():
        names["same"] = F.xxhash64(text)
    return names


def span_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", names: dict[str, Column] | None = None) -> DataFrame:
    """(h, names, pos): every run of every text, by its first sentence, under the
    ``names`` of its row (``key`` alone without them)."""
    names = names or {"key": F.col(key)}
    n_names, labels = len(names), ["h", *names, "pos"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [runs(t)[1] for t in _texts(part.column(n_names))]
                n = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.array([(h, a << 32 | e) for g in got for a, e, h in g], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[:, 0]), *(part.column(k).take(pa.array(np.repeat(np.arange(len(n)), n))) for k in range(n_names)),
                     pa.array(flat[:, 1])], names=labels)

    rows = docs.select(*[c.alias(k) for k, c in names.items()], text)
    head = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInArrow(run, f"h long, {head}, pos long")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", names: dict[str, Column] | None = None) -> DataFrame:
    """(names, spans): per document the runs (hash, pos = first << 32 | behind
    last) that stand earlier, at lesser names and pos, somewhere in ``docs``."""
    names = names or _names(docs, key, text)
    spans = span_hashes(docs, key, text, names)
    place = [*names, "pos"]
    first = spans.groupBy("h").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    own = reduce(and_, [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in place])
    return spans.join(first, "h").where(~own).groupBy(*names).agg(F.collect_set(F.struct("h", "pos")).alias("spans"))


def _cut(raw: bytes, spans) -> tuple[bytes, int, int]:
    """The text without the marked runs, the sentences and characters removed."""
    parts = sentences(raw)
    gone = np.zeros(len(parts) + 1, np.int64)
    for s in spans:
        gone[s["pos"] >> 32] += 1
        gone[s["pos"] & 0xFFFFFFFF] -= 1
    out = np.cumsum(gone[:-1]) > 0
    left = b"".join(p for p, g in zip(parts, out, strict=True) if not g)
    lost = b"".join(p for p, g in zip(parts, out, strict=True) if g)
    return left, int(out.sum()), len(lost.decode())


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences taken out of ``text`` and the columns
    removed_sentences and removed_chars (long) behind the others; a column that
    has one of these names is replaced.

    Every row stays, one whose whole text repeats with an empty text. Null
    stays null. Rows that share a key are told apart by their text and compared
    like any others; exact repeats of a row, whose runs have one key, text and
    place, are left alike. A null key sorts before all others."""
    docs = docs.drop("removed_sentences", "removed_chars")
    cols = docs.columns
    names = _names(docs, key, text)
    marks = repeated_spans(docs, key, text, names)
    found, = free(cols, "_spans")
    on = [c.eqNullSafe(marks[k]) for k, c in {**names, "key": docs[key]}.items()]
    joined = docs.join(marks, reduce(and_, on), "left").select(*[docs[c] for c in cols], marks["spans"].alias(found))
    at = cols.index(text)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, marked = _texts(part.column(at)), part.column(len(cols)).to_pylist()
                got = [_cut(t, s) if s else (t, 0, 0) for t, s in zip(texts, marked, strict=True)]
                new = pa.array([g[0].decode() for g in got], part.column(at).type, mask=part.column(at).is_null().to_numpy(False))
                yield pa.RecordBatch.from_arrays(
                    [new if k == at else part.column(k) for k in range(len(cols))]
                    + [pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                    names=[*cols, "removed_sentences", "removed_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{schema}, removed_sentences long, removed_chars long")


def clean_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated spans, columns as they were: a document
    that loses its last word goes (one that had none stays), and ``chars``, if
    there is such a column, follows a text that changed."""
    done = dedup_spans(docs, key, text)
    done = done.where((F.col("removed_sentences") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if chars in docs.columns:
        kind = docs.schema[chars].dataType
        done = done.withColumn(chars, F.when(F.col("removed_sentences") > 0, F.length(text).cast(kind)).otherwise(F.col(chars)))
    return done.select(*docs.columns)
