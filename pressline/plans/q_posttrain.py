"""Registered queries: post-training and long-context data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.fixed import PREF_KEEP
from pressline.operators import posttrain as D
from pressline.plans.fixtures import SQL_CANDIDATES, SQL_LOGITS, candidates, logits
from pressline.plans.registry import register, with_ctes
from pressline.sources.tables import table

SQL_PAIRS = SQL_CANDIDATES + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, response) AS rb,
            row_number() OVER (PARTITION BY prompt ORDER BY score, response) AS rw
  FROM candidates
),
pairs AS (
  SELECT prompt, max(response) FILTER (WHERE rb = 1) AS chosen, max(response) FILTER (WHERE rw = 1) AS rejected,
         max(score) AS chosen_score, min(score) AS rejected_score, CAST(count(*) AS BIGINT) AS candidates
  FROM ranked GROUP BY prompt
)"""


@register("build_pairs", sql=with_ctes(SQL_PAIRS, body="SELECT * FROM pairs"))
def build_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Per prompt (source) the best and worst scored responses."""
    return D.build_pairs(candidates(spark, sf))


@register("pair_ranking_loss", sql=with_ctes(SQL_PAIRS, body="""
SELECT prompt, round(CASE WHEN d >= 0 THEN ln(1 + exp(-d)) ELSE -d + ln(1 + exp(d)) END, 9) AS loss
FROM (SELECT prompt, (chosen_score - rejected_score) / 100.0 AS d FROM pairs)"""))
def pair_ranking_loss(spark: SparkSession, sf: str) -> DataFrame:
    """``-log sigmoid(r_chosen - r_rejected)`` with rewards = score / 100."""
    p = D.build_pairs(candidates(spark, sf))
    loss = D.pair_loss(F.col("chosen_score") / 100.0, F.col("rejected_score") / 100.0)
    return p.select("prompt", F.round(loss, 9).alias("loss"))


@register("best_of_k", sql=with_ctes(SQL_CANDIDATES, body="""
SELECT prompt, arg_max(response, score * 100000000 - response) AS best_response, max(score) AS best_score
FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY response) AS rn FROM candidates) WHERE rn <= 10
GROUP BY prompt"""))
def best_of_k(spark: SparkSession, sf: str) -> DataFrame:
    """D3: rejection sampling: best of the first 10 candidates per prompt."""
    return D.best_of_k(candidates(spark, sf), 10)


@register("pref_filter", sql="""
SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'significantly better' WHEN quality = 1 THEN 'better'
                      WHEN toxic = 0 THEN 'slightly better' ELSE 'negligibly better or unsure' END AS strength
FROM labels l WHERE quality = 1""")
def pref_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Keep preference pairs labelled 'significantly better' or 'better'."""
    lab = table(spark, sf, "labels")
    s = lab.select("doc_id", D.strength(F.col("quality"), F.col("toxic")).alias("strength"))
    return s.filter(F.col("strength").isin(*PREF_KEEP))


@register("rank_triple", sql=with_ctes(SQL_CANDIDATES, """
top3 AS (SELECT * FROM (SELECT prompt, response, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, response) AS rk
                         FROM candidates) WHERE rk <= 3)""", body="""
SELECT a.prompt, a.rk AS rank_a, b.rk AS rank_b, a.response AS preferred, b.response AS other
FROM top3 a JOIN top3 b ON a.prompt = b.prompt AND a.rk < b.rk"""))
def rank_triple(spark: SparkSession, sf: str) -> DataFrame:
    """Edited > chosen > rejected (top three by score) as ordered pairs."""
    from pyspark.sql import Window

    c = candidates(spark, sf)
    w = Window.partitionBy("prompt").orderBy(F.col("score").desc(), "response")
    top3 = c.withColumn("rk", F.row_number().over(w).cast("long")).filter(F.col("rk") <= 3)
    p = D.rank_pairs(top3, ["prompt"], "rk", "response")
    return p.select("prompt", "rank_a", "rank_b", "preferred", "other")


@register("concat_responses", sql="""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_responses,
       string_agg(text, chr(10) || '---' || chr(10) ORDER BY md5('42|' || conv_id || '|' || turn), text) AS responses
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def concat_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's assistant responses in one row, in a seeded
    reproducible shuffled order."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    c = c.withColumn("_o", D.seeded_order(42, F.col("conv_id"), F.col("turn")))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_o", "text"))).alias("r"))
    return g.select("conv_id", F.size("r").alias("n_responses"),
                    F.array_join(F.transform("r", lambda x: x["text"]), "\n---\n").alias("responses"))


@register("loss_mask", sql="""
SELECT conv_id, CAST(sum(2 + octet_length(encode(role)) + 1 + octet_length(encode(text))) AS BIGINT) AS total_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN octet_length(encode(text)) + 1 ELSE 0 END) AS BIGINT) AS supervised_tokens
FROM conversations GROUP BY conv_id""")
def loss_mask(spark: SparkSession, sf: str) -> DataFrame:
    """SFT loss mask on byte-level chat tokens: only assistant content
    and its EOD are supervised; BOD, role and newline, and every prompt
    message are masked."""
    c = table(spark, sf, "conversations")
    total = 2 + F.octet_length("role") + 1 + F.octet_length("text")
    sup = F.when(F.col("role") == "assistant", F.octet_length("text") + 1).otherwise(F.lit(0))
    return c.groupBy("conv_id").agg(F.sum(total).cast("long").alias("total_tokens"),
                                    F.sum(sup).cast("long").alias("supervised_tokens"))


@register("data_mix", sql="""
WITH w AS (SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 1.3::DOUBLE ELSE 0.7::DOUBLE END AS w,
                  CAST('0x' || substr(md5('7|' || doc_id), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, source, floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END AS n FROM w)
SELECT source, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT doc_id) AS docs FROM n WHERE n > 0 GROUP BY source""")
def data_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Upsample sources src0-src5 by 1.3 and downsample the rest to 0.7."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    w = F.when(F.col("source").isin(*[f"src{i}" for i in range(6)]), F.lit(1.3)).otherwise(F.lit(0.7))
    m = D.data_mix(d, w, F.col("doc_id"), seed=7)
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("docs"))


@register("iterative_rounds", sql="""
SELECT r AS round, CAST(count(*) FILTER (WHERE doc_id % 6 + 1 = r) AS BIGINT) AS pref_docs,
       CAST(count(*) FILTER (WHERE doc_id % 6 + 1 <= r) AS BIGINT) AS reward_docs
FROM documents, range(1, 7) t(r) GROUP BY r""")
def iterative_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Six rounds; a round's preference data is the newest round only,
    its reward data every round so far (one pass, explode over rounds)."""
    d = table(spark, sf, "documents").select((F.col("doc_id") % 6 + 1).alias("dr"))
    t = d.withColumn("round", F.explode(F.sequence(F.col("dr").cast("long"), F.lit(6).cast("long"))))
    return t.groupBy("round").agg(F.count_if(F.col("dr") == F.col("round")).cast("long").alias("pref_docs"),
                                  F.count(F.lit(1)).alias("reward_docs"))


@register("needle_cases", sql="""
WITH g AS (SELECT CAST(d AS DOUBLE) AS depth, CAST(l AS INTEGER) AS len FROM (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) a(d), (VALUES (1000), (2000), (4000)) b(l)),
c AS (
  SELECT g.depth, g.len, CAST(floor(g.depth * g.len) AS INTEGER) AS at_pos,
         substr(substr(d.text, 1, g.len), 1, CAST(floor(g.depth * g.len) AS INTEGER)) || ' NEEDLE-' || CAST(d.doc_id AS VARCHAR) || ' '
           || substr(substr(d.text, 1, g.len), CAST(floor(g.depth * g.len) AS INTEGER) + 1) AS hay, d.doc_id
  FROM documents d, g WHERE length(d.text) >= g.len
)
SELECT depth, len, CAST(count(*) AS BIGINT) AS cases,
       round(avg(CASE WHEN regexp_extract(right(hay, 1500), 'NEEDLE-([0-9]+) ', 1) = CAST(doc_id AS VARCHAR) THEN 1.0 ELSE 0.0 END), 9) AS recall
FROM c GROUP BY CUBE (depth, len)""")
def needle_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Needle-in-a-haystack grid over depth x length. The answers are those
    of a reader that keeps the last 1 500 characters of a prompt, as a model
    with a short context does, and names the number of the needle it sees."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    number = F.col("doc_id").cast("string")
    t = D.needle_cases(d, F.concat(F.lit(" NEEDLE-"), number, F.lit(" ")), [0.0, 0.25, 0.5, 0.75, 1.0], [1000, 2000, 4000])
    answer = F.regexp_extract(F.right("haystack", F.lit(1500)), "NEEDLE-([0-9]+) ", 1)
    return D.needle_recall(t, answer, number)


@register("rolling_logprob", sql=with_ctes(SQL_LOGITS, """
lp AS (
  SELECT doc, logits[target + 1] - (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))) AS lp
  FROM logits_t WHERE target <> 0
)""", body="""
SELECT doc, round(sum(lp), 9) AS logprob, CAST(count(*) AS BIGINT) AS tokens, round(exp(-sum(lp) / count(*)), 6) AS perplexity
FROM lp GROUP BY doc"""))
def rolling_logprob(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-document log-likelihood and perplexity over non-pad targets."""
    from pressline.operators.evalops import log_softmax_at

    lg = logits(spark, sf).filter(F.col("target") != 0)
    t = lg.select("doc", log_softmax_at(F.col("logits"), F.col("target")).alias("lp"))
    g = t.groupBy("doc").agg(F.sum("lp").alias("s"), F.count(F.lit(1)).alias("tokens"))
    return g.select("doc", F.round("s", 9).alias("logprob"), "tokens",
                    F.round(F.exp(-F.col("s") / F.col("tokens")), 6).alias("perplexity"))


SQL_HOLDOUT = """
WITH dg AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [] END) AS g
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
),
bg AS (
  SELECT DISTINCT unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [] END) AS g
  FROM (SELECT string_split(text, ' ') AS w FROM benchmark)
)
"""


@register("holdout_check", sql=SQL_HOLDOUT + """
SELECT doc_id, CAST(count(*) AS BIGINT) AS matched_ngrams FROM dg JOIN bg USING (g) GROUP BY doc_id""")
def holdout_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a word 8-gram with a benchmark item (whole
    texts on both sides)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return D.holdout_check(d, table(spark, sf, "benchmark").select("text"), 8)


@register("holdout_clean", sql=SQL_HOLDOUT + """
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN bg USING (g))""")
def holdout_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus that is left, without those documents."""
    d = table(spark, sf, "documents")
    return D.holdout_clean(d, table(spark, sf, "benchmark").select("text"), 8).select("doc_id", "source", "n_chars")
