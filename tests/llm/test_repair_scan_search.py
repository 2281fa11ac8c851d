"""Turn repair, license scan and ranked search against brute force and SQL."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pressline.llm import licenses, queries, rmq_search, turn_repair

from .conftest import SF001

CONV = "conv_id long, turn long, role string, text string, copies string, paths int"


def twin(name, **tables):
    con = duckdb.connect()
    for t, data in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}')")
    return Counter(con.execute(queries.ORACLE[name]).fetchall())


def written(df, path):
    """``df`` as one Parquet file, for DuckDB."""
    pq.write_table(pa.Table.from_batches(df.toArrow().to_batches(), schema=df.toArrow().schema), path)
    return path


def test_repair_equals_sql(spark):
    got = queries.op11_turn_repair(spark, SF001)
    assert Counter(tuple(r) for r in got.collect()) == twin("op11_turn_repair", conversations=f"{SF001}/conversations.parquet")


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_odd_rows(spark, tmp_path, monkeypatch, block):
    """Nulls, ties, repeated rows, foreign columns, a conversation cut into many blocks."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rnd = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["Yes.", "no", "", None, "Hm? ", "Yes.", "a\nb!"]
    rows = [(rnd.choice([1, 2, 3, None, 4]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts), "x", 1)
            for _ in range(160)]
    rows += [(9, 0, "user", "same.", "x", 1)] * 5 + [(10, i, "user" if i % 2 else "assistant", f"t{i}.", "y", 2) for i in range(60)]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    done, turns = turn_repair.repair(turn_repair.damage(df))
    got = done.collect()
    assert Counter(tuple(r) for r in got) == twin("op11_turn_repair", conversations=written(df, f"{tmp_path}/c.parquet"))
    said = {}
    for r in sorted(turns.collect(), key=lambda r: (r.part, r.block)):
        said.setdefault(r.conv_id, []).extend(f"{t.role}:{t.text}" for t in r.repaired)
    assert {r.conv_id: r.repaired_sha256 for r in got} == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in said.items()}
    assert turn_repair.repair(turn_repair.damage(df.limit(0)))[0].count() == 0


def test_agenda_equals_all_edit_sequences():
    """Every audit up to two inserted turns, tried out."""
    rnd = random.Random(1)
    for _ in range(150):
        rows = [(rnd.choice("suax"), rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choice([1, 1, 2])) for _ in range(rnd.randint(0, 3))]
        slots = [[]] + [turn_repair.edits(*r) for r in rows]
        best = None
        for gaps in itertools.product(["", "I", "II"], repeat=len(rows) + 1):
            for chosen in itertools.product(*slots[1:]):
                cost = 5 * len("".join(gaps)) + sum(v[0] for _, v in chosen)
                audit = gaps[0] + "".join(v[2] + g for (_, v), g in zip(chosen, gaps[1:], strict=True))
                for new in itertools.product("ua", repeat=len("".join(gaps))):
                    it, state = iter(new), turn_repair.START
                    emitted = [next(it) for _ in gaps[0]]
                    for (r, _), g in zip(chosen, gaps[1:], strict=True):
                        emitted += [r] * bool(r) + [next(it) for _ in g]
                    for r in emitted:
                        state = turn_repair.STEP.get((state, r))
                    if state in turn_repair.GOALS:
                        best = min(best or (cost, audit), (cost, audit))
        assert list(turn_repair.lightest(rows).values()) == [best], rows


def brute_spans(text, notices):
    """(label, phrase) of the notices that some run of words matches."""
    words, out = licenses.reduced(text), set()
    for n in notices:
        k = licenses.most_edits(n.phrase)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                run = " ".join(words[a:b])
                if abs(len(run) - len(n.phrase)) <= k and set(n.core) <= set(words[a:b]) and edit_distance(run, n.phrase) <= k:
                    out.add((n.label, n.phrase))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_notices_equal_brute_force():
    rnd, search, hits = random.Random(3), licenses.scanner(licenses.NOTICES), 0
    for _ in range(400):
        n = rnd.choice(licenses.NOTICES)
        s = list(n.phrase)
        for _ in range(rnd.randint(0, licenses.most_edits(n.phrase) + 1)):
            at = rnd.randrange(len(s))
            s[at:at + rnd.randint(0, 1)] = rnd.choice(["", "x", " ", "e"])
        text = f"{rnd.choice(['', 'as is, ', 'über '])}{''.join(s)}{rnd.choice(['', '. Next', ' and'])}"
        line = " " + " ".join(licenses.reduced(text)) + " "
        found = {search.notices[i][0] for i, *_ in search.matches(line)}
        assert {(n.label, n.phrase) for n in found} == brute_spans(text, licenses.NOTICES), text
        hits += bool(found)
    assert hits > 200


def test_license_places(spark, odd, none):
    docs = spark.createDataFrame([
        (1, "Released UNDER the-MIT  License. under\nthe mit\tlicense", "q"), (2, "cc by nc by nc cc\x00by\x7fnc", "q"), (3, None, "q"),
        (3, "", "q"), (4, "Licensd under the Apach Licence, Version 2.0", "q"), (5, "under the mits license; éunder the mit license", "q"),
        (6, "word " * 200_000 + "cc-by-nc 4.0", "q"), (None, "under the MPL license", "q"), (7, "GNU General Public License, version 3", "q"),
    ], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_words): r[2:] for r in licenses.summary(licenses.scan(docs)).collect()}
    assert got[1, 9] == (2, 1, 5, "mit", "mit", 1.0)
    assert got[2, 8] == (2, 0, 5, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[3, 0] == (0, None, None, "", "", 0.0)
    assert got[4, 8][:5] == (0, None, None, "", "apache-2") and 0.8 < got[4, 8][5] < 1
    assert got[5, 8][:4] == (0, None, None, "")
    assert got[6, 200_005] == (1, 200_000, 200_000, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[None, 4] == (0, None, None, "", "", 0.0) and got[7, 6] == (0, None, None, "", "gpl-3", 1.0)
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_base_places_equal_sql(spark):
    """Exact places by plain string functions, over a whole table."""
    con = duckdb.connect()
    sql = " UNION ALL ".join(f"""
      SELECT doc_id, '{n.label}' AS label, len(string_split(t, ' {n.phrase} ')) - 1 AS n FROM d WHERE contains(t, ' {n.phrase} ')""" for n in licenses.BASE)
    want = Counter(con.execute(f"""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') || ' ' AS t
      FROM read_parquet('/root/testdata/sf0.01/documents.parquet')) {sql}""").fetchall())
    got = licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    phrases = {n.phrase for n in licenses.BASE}
    found = Counter((r.doc_id, s.label) for r in got for s in r.spans if s.edits == 0 and s.phrase in phrases)
    assert Counter((d, label, n) for (d, label), n in found.items()) == want and want


def test_search_equals_sql(spark):
    got = queries.op13_rmq_search(spark, SF001)
    paths = {t: f"{SF001}/{t}.parquet" for t in ("documents", "benchmark")}
    assert Counter(tuple(r) for r in got.collect()) == twin("op13_rmq_search", **paths)


def test_search_odd_rows(spark, tmp_path, monkeypatch):
    """Ties, copies, null keys and texts, repeated items, many shards, foreign columns."""
    monkeypatch.setattr(rmq_search, "SHARD_DOCS", 7)
    rnd = random.Random(2)
    words = ["the", "One", "two", "Über", "x1", "rare", "été", "common", "a", "b"]
    docs = [(i if i % 11 else None, " ".join(rnd.choices(words, range(1, 11), k=rnd.randint(0, 30))), i) for i in range(150)]
    docs += [(500 + i, "One rare été", 0) for i in range(25)] + [(600, None, 0), (601, "", 0), (602, "...", 0), (603, "the " * 50_000, 0)]
    items = [(1, "one rare", 5), (1, "été", 5), (2, None, 5), (3, "", 5), (4, "absent", 5), (None, "the b", 5), (5, "X1 x1 über", 5), (5, "X1 x1 über", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string, score int")
    got = Counter(tuple(r) for r in rmq_search.search(d, b).collect())
    assert got == twin("op13_rmq_search", documents=written(d, f"{tmp_path}/d.parquet"), benchmark=written(b, f"{tmp_path}/b.parquet"))
    monkeypatch.setattr(rmq_search, "BLOCK_TERMS", 3)  # items in several passes
    assert Counter(tuple(r) for r in rmq_search.search(d, b).collect()) == got
    assert rmq_search.search(d.limit(0), b).count() == 0 and rmq_search.search(d, b.limit(0)).count() == 0


def test_intervals_give_the_exact_best():
    rng = np.random.default_rng(0)
    for size, terms in ((1, 1), (40, 3), (700, 12)):
        doc, term = np.nonzero(rng.random((size, terms)) < 0.3)
        tf, n = rng.integers(1, 5, len(doc)), rng.integers(1, 200, size)
        weight = rng.integers(0, 3000, terms)
        shard = rmq_search.Shard(n, doc, term, tf, weight, size, int(n.sum()))
        full = np.zeros(size, np.int64)
        np.add.at(full, shard.doc, shard.impact)
        place, score = shard.search(np.arange(terms), 10)
        least = max(1, np.sort(full)[-10:][0])
        assert sorted(place) == sorted(np.flatnonzero(full >= least)) and all(full[place] == score)
