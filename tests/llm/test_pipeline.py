"""Every stage of the corpus pipeline, on what its predecessor left, against plain Python."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pressline.llm import hilbert_pack, queries, spans
from pressline.llm.common import cut

from .conftest import SF001
from .test_text_filters import WORD, _components, _fp, _rules, _shares


def _order(k):
    return (k is None, k or 0)


def _quality(rows):
    return [r for r in rows if not _rules(r.text)[5] and _shares(r.text)[3]]


def _near(rows):
    prints = [_fp(r.text) for r in rows]
    group = _components(prints)
    best = {}
    for r, p in zip(rows, prints, strict=True):
        at = (_order(r.doc_id), p - (1 << 64) * (p >> 63), r.text or "")
        best[group[p]] = min(best.get(group[p], (at, r)), (at, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def _substring(rows):
    first, out = {}, []
    at = lambda r, a, e: ((r.doc_id is not None, r.doc_id or 0), a << 32 | e)
    for r in rows:
        for a, e, h in spans.runs((r.text or "").encode())[1]:
            first[h] = min(first.get(h, at(r, a, e)), at(r, a, e))
    for r in rows:
        parts, have = spans.runs((r.text or "").encode())
        gone = {i for a, e, h in have if first[h] != at(r, a, e) for i in range(a, e)}
        left = b"".join(p for i, p in enumerate(parts) if i not in gone).decode()
        if not gone or WORD.search(left):
            out.append((r.doc_id, r.text if not gone else left, r.n_chars if not gone else len(left)))
    return out


def _mixed(docs, path):
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    rows = con.execute(queries.ORACLE["op5_wfq_mix"]).fetchall()
    return Counter({d: taken // size for d, size, _, _, taken in rows if size})


def _text(rows):
    return Counter((r.doc_id, r.text, r.n_chars) for r in rows)


@pytest.mark.parametrize("wide", [False, True])
def test_stages_equal_plain_python(spark, odd, none, tmp_path, wide):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    if wide:  # nulls, repeats, ties and foreign columns among fewer documents
        good = " ".join(f"w{i} u{i % 13}" for i in range(60))
        more = spark.createDataFrame([(None, f"{good} end", "en", None, 1), (900, f"{good} tail", "en", "x", 2), (900, f"{good} tail", "en", "x", 2),
                                      (901, None, None, None, None), (902, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.where("doc_id < 70").select(more.columns).unionByName(more).unionByName(odd.drop("fp"))
        docs = docs.withColumn("target", F.lit("mine")).withColumn("_key", F.col("doc_id"))
    stages, brute = corpus_pipeline.STAGES, [_quality, _near, _substring]
    for k, (name, stage) in enumerate(stages):
        rows = docs.collect()
        out = cut(stage(spark, docs, SF001), name)
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        if k < 3:
            want = brute[k](rows)
            assert _text(out.collect()) == (Counter(want) if k == 2 else _text(want)), name
        elif k == 3:
            got = Counter(r.doc_id for r in out.collect() if WORD.search(r.text or ""))
            assert got == +_mixed(docs, f"{tmp_path}/d.parquet"), name
        else:
            tok = Tokenizer.from_file(hilbert_pack.tokenizer_path())
            ids = Counter()
            for r in rows:
                ids[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
            got = Counter()
            for r in out.collect():
                got[r.doc_id] += r.length
            assert got == ids
        docs = out
        assert stage(spark, docs.limit(0) if k < 4 else none, SF001).count() == 0
    if not wide:
        key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        whole = corpus_pipeline.run(spark, SF001)
        assert Counter(tuple(r) for r in whole.select(key).collect()) == Counter(tuple(r) for r in docs.select(key).collect())
