"""Driver contract: entry(), queries(), oracle_sql(), and streaming = batch."""

import importlib.util
import os

import pytest

from .conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = _entry_module()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns == ["stage", "docs", "corpus_tokens", "val_tokens", "train_tokens", "lost_tokens",
                          "val_docs", "train_docs", "val_blocks", "train_blocks"]


def test_oracle_keys_are_queries():
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_flagship_totals_sf0001(spark):
    """FIXTURES: one stage over all documents, V = floor(0.02 sum), T = floor(0.6 sum)."""
    m = _entry_module()
    r = {x["stage"]: x for x in m.entry(spark).collect()}["initial_stage"]
    assert r["corpus_tokens"] == 496_292
    assert r["val_tokens"] == 9_925 and r["train_tokens"] == 297_775 and r["lost_tokens"] == 1_039


@pytest.mark.parametrize("name", ["stream_pack", "stream_resume"])
def test_stream_equals_batch(spark, name):
    from pressline.plans.check import duck

    m = _entry_module()
    got = sorted(tuple(r) for r in m.queries()[name](spark, SF001).collect())
    want = sorted(tuple(r) for r in duck(SF001).execute(m.oracle_sql()[name]).fetchall())
    assert got == want
