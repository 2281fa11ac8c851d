"""License scans by fuzzy search for short notices.

A text is reduced to its lower-cased words, one space apart. A notice may be
written with up to k edits; its phrase is split into k + 1 pieces, of which at
least one then stands in the text unchanged (pigeonhole). An Aho-Corasick
automaton over all pieces finds these seeds in one pass over the whole text;
each seed gives the one window in which its notice can lie, and the regex
library's bounded-error matching verifies the window, with the match beginning
and ending at words. Every phrase that stands exactly is found that way too,
as its pieces do.

Each document is handled by itself: no shuffle, no state beyond one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Notice(NamedTuple):
    label: str
    phrase: str
    #: words that must stand unchanged, as one letter more or less names another license
    core: tuple[str, ...] = ()


#: phrases whose exact places are counted as base places
BASE = (
    Notice("mit", "under the mit license", ("mit",)),
    Notice("apache-2", "apache license version 2", ("2",)),
    Notice("cc-by-nc", "cc by nc", ("cc", "by", "nc")),
)
NOTICES = BASE + (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "www apache org licenses license 2 0", ("2", "0")),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "cc by sa", ("cc", "by", "sa")),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by", "cc by 4 0", ("cc", "by", "4", "0")),
    Notice("cc0", "cc0 1 0 universal", ("cc0", "1", "0")),
    Notice("gpl", "gnu general public license", ("gnu",)),
    Notice("gpl-2", "gnu general public license version 2", ("gnu", "2")),
    Notice("gpl-3", "gnu general public license version 3", ("gnu", "3")),
    Notice("lgpl", "gnu lesser general public license", ("gnu",)),
    Notice("agpl", "gnu affero general public license", ("gnu",)),
    Notice("mpl-2", "mozilla public license version 2", ("2",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: letters of a phrase for each edit that it may have
LETTERS_PER_EDIT = 8

# bytes of the reduced text: A-Z as a-z, ASCII other than letters and digits as a space
_REDUCED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def reduced(text: str | None) -> list[str]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text."""
    return [w for w in (text or "").encode().translate(_REDUCED).decode().split(" ") if w]


def most_edits(phrase: str) -> int:
    return len(phrase.replace(" ", "")) // LETTERS_PER_EDIT


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly one length, with their places in the phrase."""
    at = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Span(NamedTuple):
    label: str
    phrase: str
    first_word: int
    n_words: int
    edits: int
    text: str


class Scanner:
    """The compiled search for a tuple of notices."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        import ahocorasick
        import regex

        self.notices = [(n, most_edits(n.phrase)) for n in notices]
        self.exact = {n for n in notices if n in BASE}
        self.verify = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={k}}}(?= )") for n, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, k) in enumerate(self.notices):
            for at, piece in pieces(n.phrase, k):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def matches(self, text: str) -> set[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every verified window of a reduced
        text that begins and ends with a space."""
        found, tried = set(), set()
        for end, (size, places) in self.seeds.iter(text):
            for i, offset in places:
                at = end + 1 - size - offset  # where the phrase begins, unless edits before the seed moved it
                if (i, at) in tried:
                    continue
                tried.add((i, at))
                (notice, k), n = self.notices[i], len(self.notices[i][0].phrase)
                if at > 0 and text.startswith(notice.phrase + " ", at) and text[at - 1] == " ":
                    found.add((i, at, at + n, 0))
                    continue
                lo = text.find(" ", max(0, at - k - 1), max(0, at + k))
                hi = text.rfind(" ", max(0, at + n - k), at + n + k + 1)
                if k and 0 <= lo < hi and (m := self.verify[i].search(text[lo:hi + 1])) and set(notice.core) <= set(m[0].split(" ")):
                    found.add((i, lo + m.start(), lo + m.end(), sum(m.fuzzy_counts)))
        return found

    def spans(self, text: str | None) -> tuple[int, list[Span]]:
        """The number of words, and the notices found, in order. Exact base
        phrases all stay; of other matches that overlap, the one with fewer
        edits, then the longer one, then the earlier notice."""
        words = reduced(text)
        line = " " + " ".join(words) + " "
        found = sorted(self.matches(line), key=lambda x: (x[3], x[1] - x[2], x[0], x[1]))
        kept: list[tuple[int, int, int, int]] = []
        for x in found:
            i, a, b, e = x
            if e == 0 and self.notices[i][0] in self.exact or all(b <= c or d <= a for _, c, d, _ in kept):
                kept.append(x)
        kept.sort(key=lambda x: (x[1], x[2], x[0]))
        out, word, at = [], 0, 0
        for i, a, b, e in kept:
            word, at = word + line.count(" ", at, a), a
            n = self.notices[i][0]
            out.append(Span(n.label, n.phrase, word - 1, line.count(" ", a, b) + 1, e, line[a:b]))
        return len(words), out


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


_SPANS = "array<struct<label:string,phrase:string,first_word:bigint,n_words:bigint,edits:int,text:string>>"


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans) of every row: the notices found in its whole
    text with their label, place in words, edits and words as written.

    A null or empty text has no words and no spans; rows that share a doc_id
    are scanned each by itself; other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    plain = tuple(tuple(n) for n in notices)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, spans {_SPANS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(tuple(Notice(*n) for n in plain))
        for b in batches:
            got = [search.spans(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([n for n, _ in got], pa.int64()),
                pa.array([[s._asdict() for s in spans] for _, spans in got], arrow.field("spans").type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """One row per scanned row: its words, the exact base places, and labels
    with a score, 1 less the share of edits in the best match's phrase."""
    base = {(n.label, n.phrase) for n in BASE}
    phrases = F.array(*[F.lit(p) for _, p in sorted(base)])
    f = found.withColumn("base", F.filter("spans", lambda s: (s.edits == 0) & F.array_contains(phrases, s.phrase)))
    starts = F.transform("base", lambda s: s.first_word)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s.label))), ",")
    score = F.array_max(F.transform("spans", lambda s: F.lit(1.0) - s.edits / F.length(s.phrase)))
    return f.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined("base").alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"))
