"""Chat collapse, language filters, page text, class model and posting lists."""

import html
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from pressline.llm import chat_collapse, classlm, langid, lineblock, postings, queries

from .conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_chat_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    sql = queries.ORACLE["op1_chat_collapse"]
    assert Counter(con.execute(sql).fetchall()) == Counter(tuple(r) for r in queries.op1_chat_collapse(spark, SF001).collect())
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (2, 0, "user", "hi", "x"), (3, 0, "user", "hi", "x"),
            (4, 0, "user", "hi", "x"), (4, 0, "user", "hi", "x"), (5, 0, "user", None, "x"), (6, 0, None, "", "x"), (7, None, "user", "<|im_end|>", None),
            (None, 0, "user", "lost", "x"), (8, 0, "user", "long " * 50_000, "x"), (9, 1, "assistant", "yes", "x"), (9, 0, "user", "hi", "x"),
            (10, 0, "user", "hi", "x"), (10, 1, "assistant", "no", "x"), (10, 2, "user", "hi", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string")
    got = chat_collapse.collapse(df).collect()
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "c.parquet")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c.parquet')")
    assert Counter(tuple(r) for r in got) == Counter(con.execute(sql).fetchall())
    by = {r.conv_id: r for r in got}
    assert 2 not in by and 3 not in by and 4 not in by and by[1].copies == 2 and 9 not in by and by[10].n_turns == 3
    assert by[7].text == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat_collapse.collapse(df.limit(0)).count() == 0


def test_language_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    f = langid.fit(docs)
    res = langid.identify(odd, f).collect()
    assert len(res) == odd.count() and {r.lang_pred for r in res if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(none, f).count() == 0
    empty = langid.identify(odd, langid.fit(none)).collect()
    assert {(r.lang_pred, r.score) for r in empty} == {("und", 0.0)}


def test_bit_slices_hold_every_gram():
    rng = np.random.default_rng(0)
    grams = {f"l{i:03}": rng.integers(-2**62, 2**62, 500) for i in range(70)}  # more than one plane
    f = langid.Filters(grams)
    for i, lang in enumerate(f.languages):
        hit = np.ones(500, bool)
        for s in langid._slots(grams[lang].view(np.uint64)):
            hit &= (f.planes[i // 64][s] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
        assert hit.all() and f.wrong[i] < 1e-6


def test_pages_give_the_article(spark):
    pages = ds.dataset(f"{SF001}/pages.parquet").to_table().to_pylist()
    got = {r.page_id: r for r in queries.op8_lineblock(spark, SF001).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[p["page_id"]].text == "\n".join(w for w in want if w)
        assert got[p["page_id"]].n_chars == len(got[p["page_id"]].text)


def test_page_parts():
    text = "This is a paragraph of the article with enough words in it to stand out from the rest, number {}."
    body = "".join(f"<p>{text.format(i)}</p>" for i in range(4))
    for page in (
        f"<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><h1>Title</h1>{body}"
        "<div class='comments'><p>" + "I say something very long here. " * 20 + "</p></div><form><p>Your name and a lot of text</p></form><footer>(c)</footer>",
        f"<body><div id=sidebar><p>{'side text ' * 30}</p></div><div role='banner'>B</div><div class='post'><h1>Title</h1>{body}</div><aside>{'more ' * 50}</aside>",
        f"<div class=menu><ul><li>one<li>two</ul></div><main><h1>Title</h1>{body}<div class='ad'>Buy now</div></main><p>{'outside ' * 40}</p>",
    ):
        assert lineblock.main_text(page) == "\n".join(["Title", *(text.format(i) for i in range(4))])
    for odd in ("", " ", "<", "<p", "<p>", "a < b", "<!-- x", "<script>if (a<b) x", "&amp;&#65;&nope;", "<a><b></a></b>" * 50):
        lineblock.main_text(odd)
    assert lineblock.main_text("<p>a &lt; b &amp;&nbsp;&eacute;</p>") == "a < b & é"
    assert lineblock.main_text("<p>x</p>" * 3) == "x\nx\nx"


def test_page_marks_and_names_do_not_decide_alone():
    text = "This is a paragraph of the article with enough words in it to stand out from the rest, number {}."
    want = "\n".join(text.format(i) for i in range(4))
    body = "".join(f"<p>{text.format(i)}</p>" for i in range(4))
    gap = "<nav>x</nav>" * 3
    teaser = "<article><h3>A related story</h3><p>that is told elsewhere.</p></article>"
    assert lineblock.main_text(f"<body><div>{body}</div>{gap}{teaser}</body>").startswith(want)
    assert lineblock.main_text(f"<div>Menu</div>{gap}<article>{body}</article><div>More of this site</div>") == want
    assert lineblock.main_text(f"<article><p>{text.format(0)}</p>{gap}<p>x</p></article>") == text.format(0)  # a dive inside
    for wrapper in ("class='has-sidebar no-comments'", "class='comments'", "id=banner"):
        assert lineblock.main_text(f"<div {wrapper}>{body}</div>") == want
    assert lineblock.main_text(f"<form>{body}<div class='ad'>Buy now</div></form>") == want
    assert lineblock.main_text(f"<div class='menu'><div class='related'>{body}</div><p>x</p></div>") == want + "\nx"


def test_pages_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>" + "long text " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = lineblock.extract(df).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, 0), (1, 0), (None, 0), (2, 499_999)])
    assert lineblock.extract(df.limit(0)).count() == 0


def _base(rows, train):
    toks = [[*(w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), None] for t in rows]
    c = Counter(w for t, k in zip(toks, train, strict=True) if k for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t in toks]


def test_class_model(spark, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for head in (1 << 18, 700):  # all words in the broadcast, or most of them joined
        monkeypatch.setattr(classlm, "HEAD", head)
        for df in (docs, odd):
            rows = df.select("doc_id", "text").collect()
            train = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 != 1 for r in rows]
            want = sorted((r.doc_id or -1, not k, *w) for r, k, w in zip(rows, train, _base([r.text for r in rows], train), strict=True))
            got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                         for r in classlm.score(df, classlm.train_mask("doc_id", 5, 1)).collect())
            assert [g[:5] for g in got] == [w[:5] for w in want]
            assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and g[6] <= 0 for g, w in zip(got, want, strict=True))
            if df is docs:
                assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])
    assert classlm.score(none, classlm.train_mask("doc_id", 5, 1)).count() == 0
    alone = classlm.score(odd, F.lit(False)).collect()
    assert len(alone) == odd.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(1)
    kind = rng.permutation(np.repeat([0, 1, 2], 20))
    seq = [rng.integers(60)]
    for _ in range(30_000):
        seq.append(rng.choice(np.flatnonzero(kind == (kind[seq[-1]] + 1) % 3)))
    n = np.zeros((60, 60))
    np.add.at(n, (seq[:-1], seq[1:]), 1)
    g = classlm.exchange(n, 3, 20)
    assert len({(a, b) for a, b in zip(kind.tolist(), g.tolist(), strict=True)}) == 3


def test_classes_beyond_the_most_frequent_words(spark, monkeypatch):
    """Words of one ending that are not among the most frequent, one half always
    behind the other half: the order tells."""
    monkeypatch.setattr(classlm, "FREQUENT", 8)
    rng = np.random.default_rng(3)
    pick = lambda: " ".join(f"a{i}xyz b{j}xyz" for i, j in rng.integers(0, 300, (20, 2)))
    rows = [(i, pick()) for i in range(600)]
    rows += [(1000, "a1xyz b2xyz a3xyz b4xyz"), (1001, "b2xyz a1xyz b4xyz a3xyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in classlm.score(docs, F.col("doc_id") < 1000).collect()}
    assert abs(got[1000].base_score - got[1001].base_score) < 1e-9 and got[1000].score > got[1001].score + 0.5


def test_model_is_a_distribution(spark):
    """Over all words of the training texts, one unseen word per class and the end."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b c d", "x"])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in classlm.score(docs, F.lit(True)).collect()}
    assert all(s < 0 for s in got.values())


def _neighbours(rows, step, k=5):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    size = Counter(len(v) for _, v in ok).most_common(1)[0][0] if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == size]
    for i, v in ok:
        if i % step == 0:
            s = sorted({(-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 12), j) for j, w in ok if j != i})
            out[i] = [(j, -c) for c, j in s[:k]]
    return out


def test_posting_lists_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = _neighbours(rows, 50)
    got = {}
    for r in queries.op10_posting_lists(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    vec = {i: np.array(v, float) for i, v in rows}
    for q, g in got.items():
        for j, s in g.values():
            assert j != q and abs(s - vec[q] @ vec[j] / np.linalg.norm(vec[q]) / np.linalg.norm(vec[j])) < 1e-12
    hit = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q].values()}) for q in want)
    assert hit >= 0.93 * sum(map(len, want.values()))


def test_posting_lists_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(40)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40, 400)]  # a hot group of copies, queries among them
    rows += [(400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 2.0, 3.0]), (404, [float("nan")] * 4), (405, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [1.0, 0.0, 0.0, 0.0]), (406, [1.0, 2.0]), (50, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rep string")
    want = _neighbours([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 50)
    for block in (4096, 7):
        monkeypatch.setattr(postings, "BLOCK", block)
        got = {}
        for r in postings.search(df, F.pmod("id", F.lit(50)) == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    few = postings.search(df.where("vec_id in (0, 1, 2)"), F.col("id") == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert postings.search(df.limit(0), F.col("id") == 0).count() == 0


def test_class_score_equals_brute_force(spark):
    """The score from the classes found, by plain counting; and the model's
    probabilities of all tokens add up to one behind every class."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 60")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t)]
    seen = Counter(w for t in texts for w in fold(t))
    raw = {w: classlm.tokens(*_laid([w])) for w in seen}
    h = {w: int(raw[w][0][0]) for w in seen}
    counts = sorted(seen.items(), key=lambda x: (-x[1], h[x[0]]))
    frequent = np.array([h[w] for w, _ in counts[:classlm.FREQUENT]])
    own = sorted(h[w] for w, n in counts[classlm.FREQUENT:] if n >= classlm.LEAST)
    ending = {h[w]: int(raw[w][1][0]) for w in seen}
    plain = classlm.Units(frequent, np.array(own, np.int64), np.array([ending[x] for x in own]))
    units, classes, bigrams = classlm.clusters(classlm.encoded(docs.select("text"), plain), plain)
    unit = {w: int(units.of(units.codes(np.array([h[w]]), np.array([ending[h[w]]])))[0]) for w in seen}
    k, end = classlm.CLASSES, units.end
    step, share, inside = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in texts:
        prev = classes[end]
        for u in [unit[w] for w in fold(t)] + [end]:
            step[prev, classes[u]] += 1
            prev = classes[u]
    for w, n in seen.items():
        share[classes[unit[w]]] += n
        inside[classes[unit[w]]] += 1
    share[classes[end]] += len(texts)
    inside[classes[end]] += 1
    prior = (step.sum(0) + 1) / (step.sum() + k)
    trans = (step + classlm.PRIOR * prior) / (step.sum(1, keepdims=True) + classlm.PRIOR)
    emit = lambda n, c: (n + 0.5) / (share[c] + 0.5 * (inside[c] + 1))
    got = {r.doc_id: r.score for r in classlm.score(docs, F.lit(True)).collect()}
    for i, t in enumerate(texts):
        prev, want = classes[end], 0.0
        for u, n in [(unit[w], seen[w]) for w in fold(t)] + [(end, len(texts))]:
            want += math.log10(trans[prev, classes[u]] * emit(n, classes[u]))
            prev = classes[u]
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-6), i
    for prev in range(k):  # all words, one unseen word per class, the end
        whole = sum(trans[prev, classes[unit[w]]] * emit(n, classes[unit[w]]) for w, n in seen.items())
        whole += trans[prev, classes[end]] * emit(len(texts), classes[end]) + sum(trans[prev, c] * emit(0, c) for c in range(k))
        assert math.isclose(whole, 1.0, rel_tol=1e-9)


def _laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def test_page_windows_equal_brute_force():
    """Surge and dive on pages without an article, window by window."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        weight = [int(w) for w in rng.choice([0, 0, 0, 5, 30, 90, 200], n)]
        html = "".join(f"<p>{'x' * w}</p>" if w else rng.choice(["<nav>menu</nav>", f"<p><a href=q>{'l' * 9}</a></p>"]) for w in weight)
        lines = lineblock.lines_of(html)
        size = [len(t) for t, _, _ in lines]
        assert [s if 2 * p > s else 0 for s, (_, p, _) in zip(size, lines, strict=True)] == weight
        block = [sum(weight[i:i + 3]) for i in range(n)]
        limit, want, on = min(80, max(block) / 2), [], False
        for i in range(n):
            on = block[i] > 0 and (on or weight[i] > 0 and block[i] > limit)
            alone = 0 < i < n - 1 and weight[i - 1] and weight[i + 1] and want and want[-1] == i - 1
            if on and (weight[i] or size[i] and alone):
                want.append(i)
        assert lineblock.main_text(html) == "\n".join(lines[i][0] for i in want), html


def test_page_links_and_wrappers():
    long = "A long paragraph of the text with many words, so that its window surges over any limit. " * 3
    assert "see this" in lineblock.main_text(f"<div><p>{long}</p><p><a href=x>see this</a></p><p>{long}</p></div>")
    menu = "<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>"
    assert "two" not in lineblock.main_text(f"<div><p>{long}</p>{menu}<p>{long}</p></div>")
    side = "<p>Some other text of the page that stands outside, at some length.</p>" * 6
    assert long.split(",")[0] in lineblock.main_text(f"<div class='content widget'><p>{long}</p></div><div>{side}</div>")
    # without an article the tags alone would keep every line that is no boilerplate
    assert lineblock.main_text(f"<p>Date line</p>{'<nav>a menu</nav>' * 4}<p>{long}</p>{'<nav>a menu</nav>' * 4}<p>Imprint</p>") == long.strip()


def test_posting_ties_go_to_the_smaller_id(spark):
    """Scaled copies of one vector have one cosine: of 60 the least ids count."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    ids = rng.permutation(np.arange(1, 61)).tolist()
    rows = [(0, base.tolist())] + [(i, (base * 2.0 ** int(rng.integers(-6, 7))).tolist()) for i in ids]
    rows += [(1000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = postings.search(df, F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
