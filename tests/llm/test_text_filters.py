"""Repetition rules, SimHash, sentence spans and the mix against brute force."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from pressline.llm import queries, repetition, simhash, spans, wfq_mix

from .conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def _rules(text):
    w = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def _shares(text):
    """Characters in one short n-gram, in later repeats of long ones, in repeated
    lines; whether all limits hold."""
    w = WORD.findall(text or "")
    total, top, dup, ok = max(1, sum(map(len, w))), 0.0, 0.0, True
    for n, limit in repetition.TOP_LIMITS.items():
        times = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        share = max((k * sum(map(len, g)) for g, k in times.items() if k > 1), default=0) / total
        top, ok = max(top, share), ok and share <= limit
    for n, limit in repetition.NGRAM_LIMITS.items():
        seen, hit = set(), set()
        for i in range(len(w) - n + 1):
            if (g := tuple(w[i:i + n])) in seen:
                hit.update(range(i, i + n))
            seen.add(g)
        share = sum(len(w[i]) for i in hit) / total
        dup, ok = max(dup, share), ok and share <= limit
    lines, seen, again = [x for x in (text or "").split("\n") if WORD.search(x)], set(), []
    for x in lines:
        again += [x] if x in seen else []
        seen.add(x)
    share = sum(len(v) for x in again for v in WORD.findall(x)) / total
    return share, dup, top, ok and share <= repetition.LINE_LIMIT and (len(lines) < repetition.MIN_LINES or len(again) <= repetition.LINE_COUNT_LIMIT * len(lines))


def test_repetition_equals_brute_force(spark, odd, none):
    for docs in (_docs(spark), odd):
        rows = docs.collect()
        want = Counter((r.doc_id, *_rules(r.text)) for r in rows)
        got = repetition.quality_rules(docs).collect()
        assert Counter(tuple(r)[:7] for r in got) == want
        exp = sorted((r.doc_id or -1, _rules(r.text)[1], not _rules(r.text)[5] and s[3], *s[:3]) for r in rows for s in [_shares(r.text)])
        have = sorted((r.doc_id or -1, r.word_chars, r.kept, r.dup_line_share, r.dup_ngram_share, r.top_ngram_share) for r in got)
        assert [e[:3] for e in exp] == [h[:3] for h in have] and np.allclose([e[3:] for e in exp], [h[3:] for h in have])
        assert all(not (r.kept and r.base_failed) for r in got)
    assert repetition.quality_rules(none).count() == 0
    assert repetition.keep_quality(none).count() == 0
    kept = repetition.keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == 0


def test_repetition_verdict(spark):
    fresh = " ".join(f"w{i}" for i in range(300))
    part = " ".join(f"w{i}" for i in range(100, 170))
    rows = [(1, fresh), (2, fresh + " " + part), (3, "a line of words here\n" * 3 + fresh), (4, "one two three four five\n" * 40)]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].base_failed
    assert not got[4].kept and got[4].dup_line_share > 0.9
    assert 0.15 < got[2].dup_ngram_share < 0.25 and got[3].kept


def test_short_phrases_decide(spark):
    """A phrase of three words, 93 of 154, between words that differ; lines without long n-grams."""
    spam = " ".join(f"buy now cheap {'x' * (i % 3)}w{i} {'y' if i % 2 else ''}" for i in range(31))
    lines = "\n".join(x for i in range(30) for x in (f"own{i} line{i} of{i} this{i} text{i} here{i} at{i} last{i}", "go home"))
    rows = [(1, spam), (2, lines), (3, " ".join(f"w{i} v{i % 7}" for i in range(200)))]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].kept and not got[1].base_failed and got[1].dup_ngram_share == 0 and got[1].top_ngram_share > 0.5
    assert not got[2].kept and not got[2].base_failed and got[3].kept


def _fp(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    uniq = sorted(set(fps))
    a = np.array(uniq, np.uint64)
    root = dict(zip(uniq, uniq, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in uniq:
        for y in a[np.bitwise_count(a ^ np.uint64(x)) <= 2].tolist():
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in uniq}


def _check_simhash(docs):
    rows = [(r.doc_id, _fp(r.text)) for r in docs.select("doc_id", "text").collect()]
    comp = _components([f for _, f in rows])
    least = defaultdict(list)
    for k, f in rows:
        least[comp[f]].append(k)
    want = Counter((k, f, min((x for x in least[comp[f]] if x is not None), default=None)) for k, f in rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_simhash_equals_brute_force(spark, odd, none):
    _check_simhash(_docs(spark))
    _check_simhash(odd)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_hot_segments_lose_no_link(spark, monkeypatch):
    """Fingerprints that crowd one segment value, linked through shared keys."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 3, np.uint64)
    fps = [int(base[i % 3]) << 32 | int(rng.integers(0, 1 << 10)) for i in range(400)]
    fps += [f ^ (1 << int(rng.integers(0, 64))) for f in fps[:200]] + [int(x) for x in rng.integers(0, 1 << 63, 50)]
    want = _components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    for limit in (2, 64, 1 << 20):
        monkeypatch.setattr(simhash, "HOT_BUCKET", limit)
        roots = {r.node: r.root for r in simhash.components(simhash._near_pairs(df)).collect()}
        got = defaultdict(set)
        for f in set(fps):
            s = int(np.uint64(f).view(np.int64))
            got[roots.get(s, s)].add(f)
        exp = defaultdict(set)
        for f, r in want.items():
            exp[r].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, exp.values()))


def test_sentences_rejoin_and_cut_alike():
    for t in (b"", b"One. Two! 3.14 is pi... yes?\n\nNext, " + b"word " * 90 + b"end.", b"x" * 5000, b" . . ."):
        assert b"".join(spans.sentences(t)) == t


def test_spans_equal_brute_force(spark, odd, none):
    for docs in (_docs(spark), odd):
        rows = docs.select("doc_id", "text").collect()
        first = {}
        # a null key first; rows of one key by the hash of their text
        order = lambda r: (r.doc_id is not None, r.doc_id or 0, np.uint64(xxhash.xxh64_intdigest(r.text or "", seed=42)).view(np.int64))
        for r in rows:
            for a, e, h in spans.runs((r.text or "").encode())[1]:
                at = (order(r), a << 32 | e)
                first[h] = min(first.get(h, at), at)
        want = Counter()
        for r in rows:
            parts, have = spans.runs((r.text or "").encode())
            gone = {i for a, e, h in have if first[h] != (order(r), a << 32 | e) for i in range(a, e)}
            left = b"".join(p for i, p in enumerate(parts) if i not in gone).decode()
            want[(r.doc_id, None if r.text is None else left, len(gone))] += 1
        got = spans.dedup_spans(docs)
        assert Counter((r.doc_id, r.text, r.removed_sentences) for r in got.collect()) == want
        assert got.columns == [*docs.columns, "removed_sentences", "removed_chars"]
    assert spans.dedup_spans(none).count() == 0


def test_shared_passage_goes_once(spark):
    own = [" ".join(f"Own{d}n{i} alone stays here." for i in range(30)) for d in range(4)]
    passage = " ".join(f"Passage word{i} stands in several texts." for i in range(10))
    rows = [(d, own[d] + " " + passage + " " + own[d].replace("Own", "More")) for d in range(3)] + [(3, own[3])]
    got = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[3] == own[3]
    assert "Passage" not in got[1] + got[2] and got[1].count("alone") == 60


def test_short_shared_passages_go(spark):
    """66 words from the tail of a sentence to the head of another, and 60 words
    without punctuation in another case, between words of their own."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = f"{words('tail', 9)}. {words('one', 24)}. {words('two', 24)}. {words('head', 9)}"
    rows = [(d, f"{words(f'own{d}x', 9)} {passage} {words(f'own{d}y', 9)}.") for d in range(2)]
    got = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and "one5 " not in got[1] and "two5 " not in got[1] and "own1x3 " in got[1] and "own1y3 " in got[1]
    hit = 0
    for k in range(200):
        plain = words(f"w{k}n", 51)
        a, b = ({h for _, _, h in spans.runs(f"{words(f'{s}{k}u', 40)} {t} {words(f'{s}{k}v', 40)}".encode())[1]}
                for s, t in (("left", plain), ("right", plain.upper())))
        hit += bool(a & b)
    assert hit >= 196


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    want = Counter(con.execute(queries.ORACLE["op5_wfq_mix"]).fetchall())
    got = Counter(tuple(r) for r in queries.op5_wfq_mix(spark, SF001).collect())
    assert got == want


def test_mix_odd_rows_and_repeats(spark, odd, none):
    plan = wfq_mix.plan(odd).collect()
    assert len(plan) == odd.count()
    total, caps = sum(r["size"] for r in plan), 3
    assert all(0 <= r.taken <= caps * r["size"] for r in plan)
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - total) < 1e-6 and sum(taken.values()) <= total
    mixed = wfq_mix.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.repeats for r in plan)
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.repeats
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert wfq_mix.plan(none).count() == 0 and wfq_mix.mix(none).count() == 0


def test_mix_ends_with_equal_sizes(spark, tmp_path):
    """Many documents that finish at one time, or one rounding apart."""
    rnd = np.random.default_rng(4)
    tables = [[2, 8, 4, 5]] + [rnd.integers(1, 12, rnd.integers(2, 7)).tolist() for _ in range(5)]
    for k, counts in enumerate(tables):
        rows, i = [], 0
        for s, n in enumerate(counts):
            for _ in range(n):
                rows.append((i, f"s{s}" if s else None, "w " * 10))
                i += 1
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        docs.toPandas().to_parquet(path := f"{tmp_path}/{k}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT doc_id, source, text FROM read_parquet('{path}')")
        plan = wfq_mix.plan(docs).collect()
        got = Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in plan)
        assert got == Counter(con.execute(queries.ORACLE["op5_wfq_mix"]).fetchall()), counts
        # against exact fractions: what is in ends before what is out, but for rounding
        size, weight = {f"s{s}" if s else None: 10 * n for s, n in enumerate(counts)}, {}
        for j, s in enumerate(sorted(size, key=lambda x: (x is None, x or ""))):
            weight[s] = j % 3 + 1
        full, total = set(), sum(size.values())
        while True:
            level = Fraction(total - sum(3 * size[s] for s in full), sum(weight[s] for s in size if s not in full) or 1)
            more = {s for s in size if s not in full and weight[s] * level > 3 * size[s]}
            if not more:
                break
            full |= more
        target = {s: Fraction(3 * size[s]) if s in full else weight[s] * level for s in size}
        ends = [((r.source_size * c + r.cum) / target[r.source], c < r.repeats) for r in plan for c in range(3)]
        last_in, first_out = max(t for t, x in ends if x), min((t for t, x in ends if not x), default=Fraction(9))
        assert last_in <= first_out * (1 + Fraction(1, 10**12))
        assert total - sum(10 * r.repeats for r in plan) < 10 * max(1, sum(t <= first_out * (1 + Fraction(1, 10**12)) for t, x in ends if not x))


CLASHES = ["target", "repeats", "source_size", "cum", "_key", "_tie", "_time", "_spans", "_gone", "_fp", "_d_key", "_d_n", "_n", "_same",
           "row", "key", "same", "gone", "fp", "best", "root", "h", "pos", "size", "tie", "bucket", "copy", "n", "k"]


def test_foreign_columns_keep_their_values(spark, odd):
    import corpus_pipeline

    once = odd.drop("fp").dropDuplicates(["doc_id"])
    for docs in (once, odd.drop("fp")):
        wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
        stages = [f for _, f in corpus_pipeline.STAGES[:-1]]
        for f in [wfq_mix.mix, spans.dedup_spans, simhash.keep_one, *[lambda d, f=f: f(spark, d, SF001) for f in stages]]:
            out, plain = f(wide), f(docs)
            assert out.columns[:len(wide.columns)] == wide.columns
            rows = out.collect()
            assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
            same = ["doc_id", "text"]
            assert Counter(tuple(r[c] for c in same) for r in rows) == Counter(tuple(r) for r in plain.select(*same).collect())


def test_spans_under_one_key(spark):
    """Different rows with one doc_id that open alike: one keeps the passage."""
    opening = "One shared opening sentence here. Another shared sentence follows it. A third one ends the passage."
    rows = [(1, f"{opening} First tail."), (1, f"{opening} Second tail."), (1, f"{opening} Second tail.")]
    got = [r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum("third one" in t for t in got) in (1, 2) and len({t for t in got if "third one" in t}) == 1
