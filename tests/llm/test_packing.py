"""Packing against the library's own encoding of whole texts, and the curve."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pressline.llm import hilbert_pack as hp
from pressline.llm.common import text_bytes

from .conftest import SF001


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(hp.tokenizer_path())


def _check(docs, tok):
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[(r.doc_id, np.array(ids, "<u4").tobytes())] += 1
    pieces = hp.pack(docs).collect()
    seqs, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        seqs[p.sequence_id].append((p.offset, p.length))
        texts[(p.doc_id, p.doc_tokens)].append(p)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    for (k, n), ps in texts.items():
        have = [b for (d, b), c in want.items() if d == k and len(b) == 4 * n for _ in range(c)]
        assert sum(p.length for p in ps) == n * len(have)
        if len(have) == 1:
            assert b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)) == have[0]
    assert sum(len(b) * c for (_, b), c in want.items()) == 4 * sum(p.length for p in pieces)


def test_pieces_hold_every_id_once(spark, odd, none, tok):
    _check(spark.read.parquet(f"{SF001}/documents.parquet"), tok)
    _check(odd, tok)
    assert hp.pack(none).count() == 0


def test_word_encoder_equals_library(tok, monkeypatch):
    texts = ["It's   don't 3.14 \x01 a\x01b \x01\x01", "ΟΔΟΣ Σ ΑΣ. İstanbul é ́x ﬁ 가 각", " x y z", "<|endoftext|>a<|startoftext|>", "", "\n", "🙂🙃 \x7f \x00"]
    for limit in (0, 3, 400_000):
        monkeypatch.setattr(hp, "REMEMBERED", limit)
        enc = hp.WordEncoder(hp.tokenizer_path())
        for k in range(9):
            ids, n = enc.encode(*text_bytes(pa.array(texts)))
            want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
            assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
            texts = [" ".join(reversed(t.split(" "))) for t in texts[:7]] + [f"new{limit} words{k}"]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hp.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_little_padding(spark):
    row = hp.padding(hp.pack(spark.read.parquet(f"{SF001}/documents.parquet"))).first()
    assert row.padding == 0 and row.tokens / row.sequences > 2000
