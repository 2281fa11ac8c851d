"""One registered query per operator, over its whole table, and the SQL twins.

Each query gets its rows through its operator; ``ORACLE`` holds DuckDB SQL
where SQL can express the result, the others are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_collapse

    return chat_collapse.collapse(table(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hilbert_pack

    return hilbert_pack.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .classlm import train_mask

    docs = table(spark, sf_dir, "documents")
    train = train_mask("doc_id", 3, 1)
    found = langid.identify(docs, langid.fit(docs.where(train)))
    return found.select("doc_id", (~train).alias("held_out"), "lang_pred", "score")


def op5_wfq_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wfq_mix

    return wfq_mix.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spans

    d = spans.dedup_spans(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "text", "removed_sentences", "removed_chars")


def op8_lineblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lineblock

    return lineblock.extract(table(spark, sf_dir, "pages"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classlm

    return classlm.score(table(spark, sf_dir, "documents"), classlm.train_mask("doc_id", 5, 1))


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import postings

    return postings.search(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))[0]


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op13_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rmq_search

    return rmq_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_chat_collapse, op2_simhash, op3_hilbert_pack, op4_langid, op5_wfq_mix, op6_repetition, op7_sentence_spans,
    op8_lineblock, op9_class_lm, op10_posting_lists, op11_turn_repair, op12_license_scan, op13_rmq_search)}

_WORDS = r"[^\x20\x09-\x0D]+"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_chat_collapse": """
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM r),
t AS (SELECT *, length(role) || ':' || role || length(text) || ':' || text AS k,
             '<|im_start|>' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS line FROM o),
p AS (SELECT conv_id, n, string_agg(k, '') OVER w AS prefix, string_agg(line, '') OVER w AS text,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns, any_value(text) AS text
      FROM p WHERE n = n_turns GROUP BY prefix)
SELECT conv_id, n_turns, copies, text FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < n_turns)
""",
    "op5_wfq_mix": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS n FROM w),
l AS (SELECT a.*, (SELECT sum(source_size) FROM o) - coalesce((SELECT sum(b.cap) FROM o b WHERE b.n < a.n), 0) AS rest,
             (SELECT sum(b.weight) FROM o b WHERE b.n >= a.n) AS left_weight FROM o a),
f AS (SELECT n, rest, left_weight FROM l WHERE cap * left_weight > rest * weight ORDER BY n LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN f.n IS NULL OR l.n < f.n THEN l.cap::DOUBLE
             ELSE (f.rest * l.weight)::BIGINT::DOUBLE / f.left_weight::BIGINT::DOUBLE END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT c.*, copy, (c.source_size * copy + c.cum)::DOUBLE / c.target AS fin FROM c, (VALUES (0), (1), (2)) AS r(copy)),
e AS (SELECT *, sum(size) OVER (ORDER BY fin) AS used FROM k WHERE size > 0)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(x.n, 0)::BIGINT * c.size AS taken
FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM e WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id) x
  ON c.doc_id IS NOT DISTINCT FROM x.doc_id
""",
    # one row of every conversation a step; between rows at most two turns are inserted
    "op11_turn_repair": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, left(role, 1) AS ini FROM o),
z AS (SELECT *, n > 1 AND lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini NOT IN ('su', 'ua', 'au') AS illegal FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n_rows,
             count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM z GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.n_rows, 0) AS n_rows, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
             coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id),
step(q, e, role, to_q) AS (VALUES ('0', 's', NULL, 's'), ('0', 'u', 'user', 'u'), ('s', 'u', 'user', 'u'), ('u', 'a', 'assistant', 'a'), ('a', 'u', 'user', 'u')),
new(q, to_q, cost, audit, turns) AS (SELECT DISTINCT q, q, 0, '', []::VARCHAR[] FROM (SELECT q FROM step UNION ALL SELECT to_q FROM step)
  UNION ALL SELECT q, to_q, 5, 'I', [role || ':'] FROM step WHERE role IS NOT NULL
  UNION ALL SELECT x.q, y.to_q, 10, 'II', [x.role || ':', y.role || ':'] FROM step x JOIN step y ON x.to_q = y.q WHERE x.role IS NOT NULL),
e AS (SELECT conv_id, n, q, q AS to_q, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS turns FROM f, (SELECT DISTINCT q FROM new)
  UNION ALL SELECT conv_id, n, q, to_q, CASE fault WHEN 3 THEN 5 ELSE 0 END, 'K', [f.role || ':' || text] FROM f JOIN step ON ini = e WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, n, q, to_q, CASE fault WHEN 3 THEN 6 ELSE 1 END, 'R', [step.role || ':' || text] FROM f, step WHERE fault IN (0, 3) AND step.role IS NOT NULL),
p AS (SELECT a.conv_id, a.n_rows, 0::BIGINT AS n, to_q AS q, {'cost': cost, 'audit': audit, 'turns': turns} AS best FROM a, new WHERE new.q = '0'
  UNION ALL SELECT p.conv_id, p.n_rows, p.n + 1, new.to_q,
         min({'cost': p.best.cost + e.cost + new.cost, 'audit': p.best.audit || e.audit || new.audit, 'turns': p.best.turns || e.turns || new.turns})
  FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.q = p.q JOIN new ON new.q = e.to_q
  WHERE p.n < p.n_rows GROUP BY p.conv_id, p.n_rows, p.n, new.to_q)
SELECT a.conv_id, a.gaps, a.blank, a.duplicate, a.truncated, a.illegal, b.cost::BIGINT AS cost, b.audit, sha256(array_to_string(b.turns, chr(10))) AS repaired_sha256
FROM a JOIN (SELECT conv_id, unnest(min(best)) FROM p WHERE n = n_rows AND q IN ('0', 'a') GROUP BY conv_id) b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
""",
    "op13_rmq_search": rf"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_TERMS}')) AS term
           FROM (SELECT *, row_number() OVER () AS r FROM documents)),
f AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_TERMS}')) AS term FROM benchmark),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (r), g GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
}
