"""The corpus in trained ids against the public library: its ids fill the table
that the SQL twins of the trained queries read."""

import duckdb
import pyarrow as pa
import pytest

from pressline.plans import q_streaming, q_trained
from pressline.plans.check import _rows
from pressline.plans.q_text import _model
from pressline.plans.registry import ORACLE, QUERIES, load_all
from pressline.plans.sql_bpe import VOCAB

from .conftest import SF001
from .test_bpe import _library


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    texts = c.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    lib = _library([t for _, t in texts], VOCAB)
    ids = [[1, *e.ids, 2] for e in lib.encode_batch([t for _, t in texts])]
    c.register("ids", pa.table({"doc_id": [d for d, _ in texts], "ids": pa.array(ids, pa.list_(pa.int32()))}))
    c.execute("CREATE TABLE documents_tok AS SELECT d.doc_id, d.lang, d.source, d.n_chars, length(d.text) AS chars, i.ids AS text "
              "FROM documents d JOIN ids i USING (doc_id)")
    return c, lib


def test_registered_model_equals_library(spark, con):
    import json

    m = _model(spark, SF001, VOCAB)
    lib = json.loads(con[1].to_str())["model"]["merges"]
    assert [(m.tokens[a], m.tokens[b]) for a, b, _ in m.merges] == [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in lib]
    assert len(m.tokens) == VOCAB


@pytest.mark.parametrize("name", sorted(q_trained.TWINS))
def test_trained_queries_equal_sql_over_library_ids(spark, con, name):
    load_all()
    got = QUERIES[name](spark, SF001).toPandas()
    assert _rows(got, False) == _rows(con[0].execute(q_trained.TWINS[name]).df(), False) and len(got)


def test_trained_stream_equals_batch_split(spark, con):
    sql = ORACLE["stream_pack"].replace("octet_length(encode(text)) + 2", "len(text)").replace("FROM documents", "FROM documents_tok")
    got = q_streaming.stream_pack_trained(spark, SF001).toPandas()
    assert _rows(got, False) == _rows(con[0].execute(sql).df(), False) and len(got)
