"""Packing along a space-filling curve.

One pass encodes every whole text and projects its hashed bag of token ids to
a few dimensions; the place of that point on a Hilbert curve is the
document's key. The encoded table is written once, range-sorted by the key
(copies, which share one, are told apart by doc_id, so a large group of them
spreads over many ranges), and every range lays its documents end to end into
sequences. Texts never move; the ids move once.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spans_of, text_bytes
from .textbatch import per_text, word_hashes, words

SEQUENCE, END_ID = 4096, 2
DIMS, BITS, BUCKETS = 4, 12, 256
#: words whose ids a worker remembers; others are encoded when they are met
REMEMBERED = 1_000_000
VOCABULARY = "word_bpe_49k.json"
_MARK = "\x01"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file; an existing path stands for itself."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_VISIBLE = re.compile(rb"[!-~]{1,64}")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Ids of whole texts, word by word.

    The vocabulary's pattern drops white space and no token spans it, so a
    text's ids are those of its words in order. The words of a chunk are told
    apart by 64-bit hashes; those met before are looked up in sorted arrays
    that a worker keeps (REMEMBERED words, some 30 bytes each), the others go
    through the library, with a marker between them whose id no other text
    gives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids[0]
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, ends, ids
        added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)", re.I)
        probe = [b"Don't", b"it's3.14,", b"(A-b_c)", b"we'Ll'x''d", b"a1b22", b"~!@#", b"\"Quoted\"."]
        self.plain = all(self._ascii(w) == self._alone(w) for w in probe)

    def _ascii(self, word: bytes) -> list[int]:
        """Ids of a word of visible ASCII: the library's model on each piece of
        the vocabulary's pattern, without its bookkeeping of offsets. Used only
        if it gives the library's own ids for the probes."""
        return [t.id for p in _PIECES.findall(word.decode().lower()) for t in self.tok.model.tokenize(p)]

    def _alone(self, word: bytes) -> list[int]:
        return self.tok.encode(word.decode(), add_special_tokens=False).ids

    def _library(self, words: list[bytes]) -> list:
        """The ids of each word."""
        out: list = [None] * len(words)
        if self.plain:
            for i, w in enumerate(words):
                if _VISIBLE.fullmatch(w) and not self.added.search(w):
                    out[i] = self._ascii(w)
        plain = [i for i, w in enumerate(words) if out[i] is None and b"\x01" not in w]
        for k in range(0, len(plain), 64):
            part = plain[k:k + 64]
            text = f" {_MARK} ".join([words[i].decode() for i in part])
            ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ends = [k for k, x in enumerate(ids) if x == self.mark]
            if len(ends) != len(part) - 1:  # never seen; the words one by one are right in any case
                continue
            at = 0
            for i, e in zip(part, [*ends, len(ids)], strict=True):
                out[i] = ids[at:e]
                at = e + 1
        return [self._alone(w) if x is None else x for w, x in zip(words, out, strict=True)]

    def _remember(self, level: tuple) -> None:
        self.levels.append(level)
        if len(self.levels) > 6:
            h = np.concatenate([x[0] for x in self.levels])
            count = np.concatenate([np.diff(x[1], prepend=0) for x in self.levels])
            ids, order = np.concatenate([x[2] for x in self.levels]), np.argsort(h)
            begin = (np.cumsum(count) - count)[order]
            self.levels = [(h[order], np.cumsum(count[order]), ids[_ranges(begin, count[order])])]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts end to end, and the number of each text's."""
        starts, ends, first = words(buf, off)
        hashes, at, inverse = np.unique(word_hashes(buf, starts, ends, False), return_index=True, return_inverse=True)
        count, begin, flats, base = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), [], 0
        for h, end, ids in self.levels:
            todo = np.flatnonzero(count < 0)
            place = np.minimum(np.searchsorted(h, hashes[todo]), len(h) - 1)
            hit = h[place] == hashes[todo]
            todo, place = todo[hit], place[hit]
            count[todo] = end[place] - np.where(place, end[place - 1], 0)
            begin[todo] = base + end[place] - count[todo]
            flats.append(ids)
            base += len(ids)
        new = np.flatnonzero(count < 0)
        if len(new):
            got = self._library([buf[a:e].tobytes() for a, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            count[new] = list(map(len, got))
            end, ids = np.cumsum(count[new]), np.fromiter(chain.from_iterable(got), self.kind)
            begin[new] = base + end - count[new]
            flats.append(ids)
            if sum(len(x[0]) for x in self.levels) + len(new) <= REMEMBERED:
                self._remember((hashes[new], end, ids))
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(off) - 1, np.int64)
        each = count[inverse]
        # the levels are read in place: gathered per level, not joined into one array
        out, where = np.empty(int(each.sum()), self.kind), np.cumsum(each) - each
        lo = 0
        for ids in flats:
            mine = np.flatnonzero((begin[inverse] >= lo) & (begin[inverse] < lo + len(ids)) & (each > 0))
            out[_ranges(where[mine], each[mine])] = ids[_ranges(begin[inverse[mine]] - lo, each[mine])]
            lo += len(ids)
        return out, per_text(each, first)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    end = np.cumsum(count)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - end + count, count)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(name: str) -> WordEncoder:
    if name not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[name] = WordEncoder(tokenizer_path(name))
    return _ENCODERS[name]


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dims), each below 2^bits."""
    x = x.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, highest first
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids stand end to end, ``count`` each."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    cell = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    doc = np.repeat(np.arange(len(count)), count)
    v = np.bincount(doc * BUCKETS + cell, weights=sign, minlength=len(count) * BUCKETS).astype(float).reshape(-1, BUCKETS)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    plane = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    unit = 1 / (1 + np.exp(-1.702 * (v @ plane)))
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, curve long, n long, ids binary, width int): the ids of every whole
    text (null: empty) and END_ID, ``width`` little-endian bytes each."""
    def run(batches):
        enc = _encoder(vocabulary)
        end, size = np.array([END_ID], enc.kind).tobytes(), enc.kind.itemsize
        for b in batches:
            buf, off = text_bytes(b.column(1))
            for i, j in spans_of(off):
                ids, n = enc.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                raw, cuts = ids.tobytes(), np.append(0, np.cumsum(n) * size).tolist()
                got = [raw[a:e] + end for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(curve_keys(ids, n)), pa.array(n + 1), pa.array(got, pa.binary()),
                     pa.array(np.full(len(got), size, np.int32))], names=[key, "curve", "n", "ids", "width"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, curve long, n long, ids binary, width int")


def _pieces(rows, size: int):
    """(row, start, ids, sequence, offset) of rows (row, ids) laid end to end.
    The last sequence is cut into lengths that are powers of two, which need
    no padding."""
    seq, room, held = 0, size, []
    for row, ids in rows:
        start = 0
        while start < len(ids):
            part = ids[start:start + room]
            held.append((row, start, part, size - room))
            start += len(part)
            room -= len(part)
            if not room:
                yield from ((r, s, p, seq, o) for r, s, p, o in held)
                seq, room, held = seq + 1, size, []
    left = size - room
    fill = 1 << max(left.bit_length() - 1, 0)
    offset = 0
    for r, s, p, _ in held:
        while len(p):
            part = p[:fill - offset]
            yield r, s, part, seq, offset
            s, p, offset = s + len(part), p[len(part):], offset + len(part)
            if offset == fill:
                left -= fill
                seq, offset, fill = seq + 1, 0, 1 << max(left.bit_length() - 1, 0)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset long,
    ids binary): one row per piece of a document in a sequence.

    ``ids`` are little-endian unsigned 32-bit. Sequences hold ``sequence``
    ids; each range ends in sequences of powers of two, so nothing is padded.
    Every row of ``docs`` is a document of its own, repeated rows and null
    keys too; null, empty and blank texts have the end id only. Extra columns
    are not read. An empty table gives no rows."""
    coded = cut(encode_documents(docs, key, text, vocabulary), "encoded")
    order = ["curve", key, "n"]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        base = TaskContext.get().partitionId() << 36

        def rows():
            for b in batches:
                keys, ids, width = b.column(0), b.column(3), b.column(4)
                for i in range(b.num_rows):
                    yield (keys[i], b.column(2)[i].as_py()), np.frombuffer(ids[i].as_buffer(), f"<u{width[i].as_py()}")

        held, weight = [], 0
        for (k, n), start, part, seq, offset in _pieces(rows(), sequence):
            raw = part.astype("<u4").tobytes()
            held.append((k.as_py(), start, len(part), zlib.crc32(raw), n, base + seq, offset, raw))
            weight += len(raw)
            if weight > 8 << 20 or len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, h, strict=True)) for h in held], schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, h, strict=True)) for h in held], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = pa.schema([(key, to_arrow_type(docs.schema[key].dataType)), *[(x, pa.int64()) for x in names[1:7]], ("ids", pa.binary())])
    kind = docs.schema[key].dataType.simpleString()
    return ranged.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{x} long" for x in names[1:7]) + ", ids binary")


def padding(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """(sequences, tokens, padding): what ``pack`` gives, in figures."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return s.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"),
                 F.sum(F.when(whole, 0).otherwise(sequence - F.col("n"))).alias("padding"))
