"""Registered queries: evaluation operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.bytes_ import byte_ids, duck_byte_ids_sql
from pressline.operators import evalops as E
from pressline.operators.packing import add_markers, byte_doc_ids
from pressline.plans.fixtures import SQL_LOGITS, SQL_REQUESTS, SQL_RUN_LOG, logits, requests, run_log
from pressline.plans.registry import register, with_ctes
from pressline.session import materialize_table, scratch_path
from pressline.sources.results import ResultStore, request_key
from pressline.sources.tables import table

MAX_LEN = 128

SQL_REQ_IDS = SQL_REQUESTS + f""",
req_ids AS (
  SELECT item, task, query, choice, stops, [1] || {duck_byte_ids_sql('query')} AS ctx,
         [1] || {duck_byte_ids_sql('choice')} AS cont
  FROM requests
)"""


def _req_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf)
    return r.withColumn("ctx", add_markers(byte_ids(F.col("query")), bod=True, eod=False)) \
            .withColumn("cont", add_markers(byte_ids(F.col("choice")), bod=True, eod=False))


@register("fit_context", sql=with_ctes(SQL_REQ_IDS, """
fc AS (
  SELECT item, ctx, cont, {m} - len(cont) AS room FROM req_ids
),
fc2 AS (
  SELECT item,
         CASE WHEN room < 1 THEN ctx[len(ctx):] WHEN len(ctx) > room THEN ctx[len(ctx) - room + 1:] ELSE ctx END AS c2,
         CASE WHEN room < 1 THEN cont[1:{m} - 1] ELSE cont END AS k2
  FROM fc
)""".format(m=MAX_LEN), body="""
SELECT item, CAST(len(c2) AS INTEGER) AS ctx_len, CAST(len(k2) AS INTEGER) AS cont_len,
       c2[1] AS ctx_first, c2[len(c2)] AS ctx_last, k2[len(k2)] AS cont_last
FROM fc2"""))
def fit_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context + continuation fitted into a 128-token window."""
    r = _req_ids(spark, sf)
    c2, k2 = E.fit_context(F.col("ctx"), F.col("cont"), MAX_LEN)
    t = r.select("item", c2.alias("c2"), k2.alias("k2"))
    return t.select("item", F.size("c2").alias("ctx_len"), F.size("k2").alias("cont_len"),
                    F.element_at("c2", 1).alias("ctx_first"), F.element_at("c2", -1).alias("ctx_last"),
                    F.element_at("k2", -1).alias("cont_last"))


SQL_LSM = SQL_LOGITS + """,
lsm AS (
  SELECT doc, pos, target,
         logits[target + 1] - (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))) AS lp,
         list_position(logits, list_max(logits)) - 1 AS am
  FROM logits_t
)"""


def _lsm(spark: SparkSession, sf: str) -> DataFrame:
    lg = logits(spark, sf)
    return lg.select("doc", "pos", "target", E.log_softmax_at(F.col("logits"), F.col("target")).alias("lp"),
                     E.argmax(F.col("logits")).alias("am"))


@register("continuation_logprob", sql=with_ctes(SQL_LSM, body="""
SELECT doc, round(sum(lp), 9) AS logprob FROM lsm WHERE pos BETWEEN 4 AND 6 GROUP BY doc"""))
def continuation_logprob(spark: SparkSession, sf: str) -> DataFrame:
    """A 3-token continuation at the end of each 8-position document is
    scored by the logits one position before each token (positions 4..6)."""
    t = _lsm(spark, sf).filter(F.col("pos").between(4, 6))
    return t.groupBy("doc").agg(F.round(F.sum("lp"), 9).alias("logprob"))


@register("greedy_match", sql=with_ctes(SQL_LSM, body="""
SELECT doc, bool_and(am = target) AS is_greedy FROM lsm WHERE pos BETWEEN 4 AND 6 GROUP BY doc"""))
def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    """True iff the argmax equals the target at every continuation position."""
    t = _lsm(spark, sf).filter(F.col("pos").between(4, 6))
    return t.groupBy("doc").agg(F.bool_and(F.col("am") == F.col("target")).alias("is_greedy"))


@register("argmax_token", sql=with_ctes(SQL_LSM, body="""
SELECT doc, CAST(arg_max(am, pos) AS BIGINT) AS next_id FROM lsm GROUP BY doc"""))
def argmax_token(spark: SparkSession, sf: str) -> DataFrame:
    """Next id = argmax of the last position's logits (lowest id on ties)."""
    return _lsm(spark, sf).groupBy("doc").agg(F.max_by("am", "pos").alias("next_id"))


@register("clamp_prompt", sql=with_ctes(SQL_REQ_IDS, """
cp AS (SELECT item, CASE WHEN len(ctx) >= 64 THEN ctx[len(ctx) - 63 + 1:] ELSE ctx END AS p FROM req_ids)""", body="""
SELECT item, CAST(len(p) AS INTEGER) AS prompt_len,
       CAST(CASE WHEN len(p) + 32 > 64 THEN 64 - len(p) ELSE 32 END AS INTEGER) AS max_tokens, p[1] AS first_id
FROM cp"""))
def clamp_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """E5: prompts clamped to a 64-token window with 32 new tokens requested."""
    r = _req_ids(spark, sf)
    p, m = E.clamp_prompt(F.col("ctx"), F.lit(32), 64)
    t = r.select("item", p.alias("p"), m.alias("m"))
    return t.select("item", F.size("p").alias("prompt_len"), F.col("m").cast("int").alias("max_tokens"),
                    F.element_at("p", 1).alias("first_id"))


@register("cut_at_eod", sql=f"""
WITH d AS (SELECT doc_id, [1] || {duck_byte_ids_sql('text')} || [2] AS ids FROM documents),
c AS (SELECT doc_id, ids[1:least(CASE WHEN list_position(ids, 2) IS NULL THEN len(ids) ELSE list_position(ids, 2) - 1 END, 299)] AS o FROM d)
SELECT doc_id, CAST(len(o) AS INTEGER) AS n_emitted, CAST(list_sum(o) AS BIGINT) AS emitted_sum FROM c""")
def cut_at_eod(spark: SparkSession, sf: str) -> DataFrame:
    """Generated ids end before the first EOD, at most max_tokens - 1 (300 - 1)."""
    d = table(spark, sf, "documents").select("doc_id", byte_doc_ids(F.col("text")).alias("ids"))
    o = E.cut_at_eod(F.col("ids"), F.lit(300))
    t = d.select("doc_id", o.alias("o"))
    return t.select("doc_id", F.size("o").alias("n_emitted"),
                    F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("emitted_sum"))


@register("cut_at_stop", sql=with_ctes(SQL_REQUESTS, body="""
SELECT item, CASE WHEN len(list_filter(list_transform(stops, lambda s: instr(choice, s)), lambda p: p > 0)) = 0 THEN choice
                  ELSE substr(choice, 1, list_min(list_filter(list_transform(stops, lambda s: instr(choice, s)), lambda p: p > 0)) - 1) END AS text
FROM requests"""))
def cut_at_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Generated text cut at the earliest stop string."""
    r = requests(spark, sf)
    return r.select("item", E.cut_at_stop(F.col("choice"), F.col("stops")).alias("text"))


@register("limit_per_task", sql=with_ctes(SQL_REQUESTS, body="""
SELECT task, item FROM (SELECT task, item, row_number() OVER (PARTITION BY task ORDER BY item) AS rn FROM requests) WHERE rn <= 5"""))
def limit_per_task(spark: SparkSession, sf: str) -> DataFrame:
    """At most 5 samples per task."""
    return E.limit_per_task(requests(spark, sf), 5).select("task", "item")


SQL_RESULTS = SQL_REQUESTS + "," + SQL_LSM + """,
per AS (SELECT doc, sum(lp) AS logprob, bool_and(am = target) AS g FROM lsm WHERE pos BETWEEN 4 AND 6 GROUP BY doc),
rq AS (SELECT item, task, sha256(concat_ws('|', task, query, choice)) AS req FROM requests),
first_run AS (SELECT req FROM rq JOIN per ON per.doc = rq.item WHERE task = 'gsm8k')"""


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The requests, and their results after two evaluations into one store:
    the task gsm8k, then all tasks."""
    t = materialize_table(_lsm(spark, sf).filter(F.col("pos").between(4, 6)).groupBy("doc").agg(
        F.sum("lp").alias("logprob"), F.bool_and(F.col("am") == F.col("target")).alias("greedy")), "scores")
    r = requests(spark, sf).withColumn("req_key", request_key("task", "query", "choice"))

    def score(todo: DataFrame) -> DataFrame:
        return todo.join(t, F.col("doc") == F.col("item")).select("req_key", "task", "logprob", "greedy")

    store = ResultStore(spark, scratch_path(spark, f"eval-{uuid.uuid4().hex[:12]}"))
    store.evaluate(r.filter(F.col("task") == "gsm8k"), score, run=1)
    return r, store.evaluate(r, score, run=2)


@register("cached_eval", sql=with_ctes(SQL_RESULTS, body="""
SELECT rq.item, rq.task, CASE WHEN req IN (SELECT req FROM first_run) THEN 1 ELSE 2 END AS run, round(p.logprob, 9) AS logprob, p.g AS greedy
FROM rq JOIN per p ON p.doc = rq.item"""))
def cached_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two evaluations over one store; the second computes what
    the first has not, and each result names the run that made it."""
    return _stored(spark, sf)[1].select("item", "task", "run", F.round("logprob", 9).alias("logprob"), "greedy")


@register("eval_tasks", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, split_part(t, '|', 1) AS task, CAST(split_part(t, '|', 2) AS INTEGER) AS n_shot
FROM (SELECT run, unnest(string_split(CASE WHEN arg_max(stage, step) IN ('annealing_stage', 'complete')
                                       THEN 'gsm8k|5,math|4' END, ',')) AS t FROM run_log GROUP BY run)"""))
def eval_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark list for the stage each run ends in, parsed
    into (task, n_shot); a long-context stage raises."""
    last = run_log(spark, sf).groupBy("run").agg(F.max_by("stage", "step").alias("stage"))
    spec = last.withColumn("spec", E.eval_tasks(F.col("stage")))
    return E.parse_task_spec(spec).select("run", "task", "n_shot")


@register("eval_summary", sql=with_ctes(SQL_REQUESTS, SQL_LSM, """
per AS (SELECT doc, sum(lp) AS logprob, bool_and(am = target) AS g FROM lsm WHERE pos BETWEEN 4 AND 6 GROUP BY doc)""", body="""
SELECT r.task, CAST(count(*) AS BIGINT) AS n, round(avg(p.logprob), 9) AS avg_logprob,
       round(avg(CASE WHEN p.g THEN 1.0 ELSE 0.0 END), 9) AS greedy_acc
FROM requests r JOIN per p ON p.doc = r.item GROUP BY r.task"""))
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per-task summary of the per-sample results, read back from the store
    that they were written to."""
    return _stored(spark, sf)[1].groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("logprob"), 9).alias("avg_logprob"),
        F.round(F.avg(F.when(F.col("greedy"), 1.0).otherwise(0.0)), 9).alias("greedy_acc"))
