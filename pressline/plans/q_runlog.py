"""Registered queries: run-log metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators import evalops as E
from pressline.operators import runlog as M
from pressline.plans.fixtures import SQL_LOGITS, SQL_RUN_LOG, SQL_VAL_LOG, logits, run_log, val_log
from pressline.plans.q_schedule import P, SQL_LR, SQL_MICRO, _lr, micro_log
from pressline.plans.registry import register, with_ctes

TOKEN_TARGETS = {"initial_stage": 2_000_000, "lc_stage": 100_000, "annealing_stage": 50_000}
ETA_TARGETS = {"initial_stage": 1000, "lc_stage": 100_000, "annealing_stage": 50_000}

SQL_CE = SQL_LOGITS + """,
ce AS (
  SELECT doc, pos, target,
         list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
           - logits[target + 1] AS nll
  FROM logits_t WHERE target <> 0
)"""


@register("cross_entropy", sql=with_ctes(SQL_CE, body="""
SELECT doc, round(avg(nll), 9) AS loss, CAST(count(*) AS BIGINT) AS tokens FROM ce GROUP BY doc"""))
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """M1: per document, mean over non-pad targets of ``logsumexp - logit[target]``."""
    ce = E.cross_entropy(logits(spark, sf), ["doc"])
    return ce.select("doc", F.round("loss", 9).alias("loss"), "tokens")


@register("online_validation", sql=with_ctes(SQL_CE, body="""
SELECT round(avg(bl), 9) AS val_loss, CAST(count(*) AS BIGINT) AS val_batches
FROM (SELECT doc // 4 AS batch, avg(nll) AS bl FROM ce GROUP BY doc // 4)"""))
def online_validation(spark: SparkSession, sf: str) -> DataFrame:
    """M2: mean over batches (4 documents each) of the batch mean loss; a
    short batch weighs as much as a full one."""
    lg = logits(spark, sf).withColumn("batch", F.floor(F.col("doc") / 4))
    per_batch = E.cross_entropy(lg, ["batch"])
    return per_batch.agg(F.round(F.avg("loss"), 9).alias("val_loss"), F.count(F.lit(1)).alias("val_batches"))


@register("run_log", sql=with_ctes(SQL_MICRO, SQL_LR, body="""
SELECT m.run, m.step, m.loss, round(l.lr, 12) AS lr, m.seq_len, 1 AS micro_batch, m.global_tokens AS global_batch_tokens,
       CAST(sum(m.seq_len) OVER (PARTITION BY m.run ORDER BY m.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_tokens,
       m.ts
FROM microA m JOIN lr_t l USING (run, step)"""))
def run_log_q(spark: SparkSession, sf: str) -> DataFrame:
    """M3: the appended per-update record (loss, LR, shapes, running tokens)."""
    from pressline.operators.ordered import prefix_sums

    m = _lr(micro_log(spark, sf))
    m = prefix_sums(m, "step", {"total_tokens": F.col("seq_len").cast("long")}, by=["run"], inclusive=True)
    return m.select("run", "step", "loss", F.round("lr", 12).alias("lr"), "seq_len", F.lit(1).alias("micro_batch"),
                    F.col("global_tokens").alias("global_batch_tokens"), "total_tokens", "ts")


@register("moving_average", sql=with_ctes(SQL_RUN_LOG, """
mw AS (SELECT run, count(*) AS n, least(100, greatest(2, count(*) // 10)) AS w FROM run_log GROUP BY run),
mwo AS (SELECT run, n, w, (w - 1) // 2 AS off FROM mw WHERE n > 1 AND n >= w)""", body="""
SELECT r.run, r.step, round(avg(x.loss), 9) AS smoothed
FROM run_log r JOIN mwo USING (run)
JOIN run_log x ON x.run = r.run AND x.step BETWEEN r.step - mwo.off AND r.step - mwo.off + mwo.w - 1
GROUP BY r.run, r.step, mwo.w HAVING count(*) = mwo.w"""))
def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    """M4: centred full-window smoothing of the loss."""
    s = M.moving_average(run_log(spark, sf))
    return s.select("run", "step", F.round("smoothed", 9).alias("smoothed"))


@register("step_axis", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, step, step + 100 AS axis_step FROM run_log"""))
def step_axis(spark: SparkSession, sf: str) -> DataFrame:
    """M5: the history of a run resumed after 100 updates is plotted at
    ``num_updates - n + 1 .. num_updates`` with num_updates = n + 100."""
    rl = run_log(spark, sf)
    return rl.select("run", "step", (F.col("n") + 100 - F.col("n") + F.col("step")).alias("axis_step"))


@register("ema", sql=with_ctes(SQL_RUN_LOG, """
e(run, step, ema) AS (
  SELECT run, step, loss FROM run_log WHERE step = 1
  UNION ALL
  SELECT r.run, r.step, 0.1 * r.loss + 0.9 * e.ema FROM e JOIN run_log r ON r.run = e.run AND r.step = e.step + 1
)""", body="""
SELECT run, step, round(ema, 6) AS ema FROM e""").replace("WITH ", "WITH RECURSIVE ", 1))
def ema(spark: SparkSession, sf: str) -> DataFrame:
    """M6: exponential moving average of the loss per run (alpha 0.1)."""
    e = M.ema(run_log(spark, sf))
    return e.select("run", "step", F.round("ema", 6).alias("ema"))


@register("step_interval", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, step, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step))) / 1e6, 6) AS interval_sec
FROM run_log"""))
def step_interval(spark: SparkSession, sf: str) -> DataFrame:
    """M7: seconds since the previous update of the run."""
    s = M.step_interval(run_log(spark, sf))
    return s.select("run", "step", F.round("interval_sec", 6).alias("interval_sec"))


@register("throughput_eta", sql=with_ctes(SQL_MICRO, """
eta0 AS (
  SELECT run, step, stage, stage_step, stage_tokens,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run, stage))) / 1e6 AS elapsed,
         CASE WHEN stage = 'initial_stage' THEN stage_step ELSE stage_tokens END AS done,
         CASE stage WHEN 'initial_stage' THEN 1000 WHEN 'lc_stage' THEN 100000 ELSE 50000 END AS target
  FROM microA
)""", body="""
SELECT run, step, round(elapsed, 6) AS elapsed_sec,
       CAST(CASE WHEN done = 0 OR elapsed <= 0 THEN 0 ELSE floor(greatest((target - done) / (done / elapsed), 0.0)) END AS BIGINT) AS eta_sec
FROM eta0"""))
def throughput_eta(spark: SparkSession, sf: str) -> DataFrame:
    """M8: ETA from the rate since the stage's first timestamp."""
    t = M.throughput_eta(micro_log(spark, sf), ETA_TARGETS)
    return t.select("run", "step", F.round("elapsed_sec", 6).alias("elapsed_sec"), "eta_sec")


@register("stage_markers", sql=with_ctes(SQL_RUN_LOG, """
tr AS (
  SELECT run, CASE stage WHEN 'lc_stage' THEN '→ lc_stage Start' ELSE '→ annealing_stage Start' END AS label,
         CAST(min(step) - 1 AS BIGINT) AS step
  FROM run_log WHERE stage <> 'initial_stage' GROUP BY run, stage
  UNION ALL SELECT run, '→ annealing_stage End', CAST(max(step) AS BIGINT) FROM run_log GROUP BY run
  UNION ALL SELECT run, '→ Warmup End & Initial stage start', CAST(100 AS BIGINT) FROM run_log GROUP BY run
),
rng AS (SELECT run, min(step) AS lo, max(step) AS hi FROM run_log GROUP BY run)""", body="""
SELECT tr.run, tr.label, tr.step FROM tr JOIN rng USING (run) WHERE tr.step <> 0 AND tr.step BETWEEN rng.lo AND rng.hi"""))
def stage_markers(spark: SparkSession, sf: str) -> DataFrame:
    """M9: labelled boundaries (warm-up end, stage starts, end) inside the range."""
    return M.stage_markers(run_log(spark, sf), P["warmup_steps"]).select("run", "label", "step")


@register("tick_union", sql=with_ctes(SQL_RUN_LOG, """
ex AS (
  SELECT run, CAST(min(step) - 1 AS BIGINT) AS tick FROM run_log WHERE stage <> 'initial_stage' GROUP BY run, stage
  UNION ALL SELECT run, CAST(max(step) AS BIGINT) FROM run_log GROUP BY run
),
rng AS (SELECT run, min(step) AS lo, max(step) AS hi FROM run_log GROUP BY run)""", body="""
SELECT DISTINCT u.run, u.tick FROM (
  SELECT run, step AS tick FROM run_log WHERE step % 250 = 0
  UNION SELECT run, tick FROM ex WHERE tick IS NOT NULL) u
JOIN rng USING (run) WHERE u.tick BETWEEN rng.lo AND rng.hi"""))
def tick_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of axis ticks and explicit steps, clipped, distinct, sorted."""
    return M.tick_union(run_log(spark, sf), 250).select("run", "tick")


@register("val_clip", sql=with_ctes(SQL_RUN_LOG, SQL_VAL_LOG, body="""
SELECT v.run, v.step, round(v.loss, 9) AS loss FROM val_log v
JOIN (SELECT run, max(step) AS hi, count(*) AS n FROM run_log WHERE stage <> 'initial_stage' GROUP BY run) r USING (run)
WHERE v.step BETWEEN r.hi - r.n + 1 AND r.hi"""))
def val_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Validation points inside the plotted range of runs that were resumed
    behind their initial stage: their loss history starts there."""
    history = run_log(spark, sf).filter(F.col("stage") != "initial_stage")
    return M.val_clip(val_log(spark, sf), history).select("run", "step", F.round("loss", 9).alias("loss"))


@register("log_overlay", sql=with_ctes(SQL_MICRO, SQL_LR, SQL_VAL_LOG.replace("run_log", "microA"), body="""
SELECT l.run, l.step, round(m.loss, 9) AS loss, round(v.loss, 9) AS val_loss, round(l.lr, 12) AS lr, m.seq_len
FROM lr_t l JOIN microA m USING (run, step) LEFT JOIN val_log v USING (run, step)"""))
def log_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Loss, LR, validation loss and shapes on one step axis (left joins
    on (run, step))."""
    m = _lr(micro_log(spark, sf))
    v = m.filter(F.col("step") % 200 == 0).select("run", "step", (F.col("loss") * 1.1).alias("val_loss"))
    t = m.join(v, ["run", "step"], "left")
    return t.select("run", "step", F.round("loss", 9).alias("loss"), F.round("val_loss", 9).alias("val_loss"),
                    F.round("lr", 12).alias("lr"), "seq_len")


_CLOCK = """CASE WHEN {0} >= 86400 THEN ({0} // 86400)::VARCHAR || CASE WHEN {0} // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END
  || printf('%d:%02d:%02d', {0} % 86400 // 3600, {0} % 3600 // 60, {0} % 60)"""
_GROUPED = r"reverse(rtrim(regexp_replace(reverse({0}), '(\d{{3}})', '\1,', 'g'), ','))"


@register("log_line", sql="WITH RECURSIVE " + with_ctes(SQL_MICRO, SQL_LR, """
iv AS (SELECT run, step, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step))) / 1e6, 0) AS sec,
              CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run))) / 1e6) AS BIGINT) AS since FROM microA),
av(run, step, avg) AS (
  SELECT run, step, sec FROM iv WHERE step = 1
  UNION ALL
  SELECT i.run, i.step, 0.1 * i.sec + 0.9 * av.avg FROM av JOIN iv i ON i.run = av.run AND i.step = av.step + 1
),
eta0 AS (
  SELECT run, step, stage, stage_step, stage_tokens, ts, loss,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run, stage))) / 1e6 AS elapsed,
         CASE WHEN stage = 'initial_stage' THEN stage_step ELSE stage_tokens END AS done,
         CASE stage WHEN 'initial_stage' THEN 1000 WHEN 'lc_stage' THEN 100000 ELSE 50000 END AS target,
         CASE stage WHEN 'initial_stage' THEN 2000000 WHEN 'lc_stage' THEN 100000 ELSE 50000 END AS goal
  FROM microA
),
eta AS (SELECT *, CAST(CASE WHEN done = 0 OR elapsed <= 0 THEN 0 ELSE floor(greatest((target - done) / (done / elapsed), 0.0)) END AS BIGINT) AS left_s FROM eta0)""", body=f"""
SELECT m.run, m.step,
       printf('[%s] | num_grad_updates: %4d | %s | Tokens: %s/%s | Avg Time: %5.2fs | Elapsed: %8s | ETA: %8s | LR: %15.8f | Loss: %7.4f',
              strftime(m.ts, '%m-%d %H:%M:%S'), m.step,
              CASE WHEN m.stage = 'initial_stage' THEN printf('Step: %4d/1000', m.stage_step) ELSE repeat(' ', 15) END,
              {_GROUPED.format("lpad(m.stage_tokens::VARCHAR, greatest(7, length(m.stage_tokens::VARCHAR))::INTEGER, '0')")}, {_GROUPED.format("m.goal::VARCHAR")},
              floor(round(av.avg, 9) * 100 + 0.5) / 100, {_CLOCK.format("iv.since")}, {_CLOCK.format("m.left_s")}, l.lr, m.loss) AS line
FROM eta m JOIN lr_t l USING (run, step) JOIN iv USING (run, step) JOIN av USING (run, step)""").removeprefix("WITH "))
def log_line(spark: SparkSession, sf: str) -> DataFrame:
    """The whole status line of each update."""
    return M.log_line(_lr(micro_log(spark, sf)), P["steps"], TOKEN_TARGETS).select("run", "step", "line")
