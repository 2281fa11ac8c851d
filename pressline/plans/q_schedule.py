"""Registered queries: schedules and grouping arithmetic on the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators import schedule as C
from pressline.plans.fixtures import SQL_RUN_LOG, run_log
from pressline.plans.registry import register, with_ctes
from pressline.session import materialize

# schedule parameters applied to the events-derived run log
P = dict(steps=1000, warmup_steps=100, peak_lr=1e-3, decay_lr_to=1e-4, lc_tokens=100_000,
         anneal_tokens=50_000, anneal_decay_to=0.0)
L0, G0, FIRST, SECOND = 128, 256, 5000, 8000
LC_START, LC_END, MICRO = 512, 1024, 1


def micro_log(spark: SparkSession, sf: str) -> DataFrame:
    """Run log with the shape each micro-step runs at (computed from the
    tokens processed *before* the row) and its accumulation target ``A``."""
    rl = C.stage_progress(run_log(spark, sf))
    before = F.col("stage_tokens") - 256
    ini = C.initial_shape(before, L0, G0, FIRST, SECOND)
    rl = rl.withColumn("_iseq", ini["seq_len"]).withColumn("_ig", ini["global_tokens"])
    g_inh = (rl.filter(F.col("stage") == "initial_stage").groupBy("run")
             .agg(F.max_by("_ig", "step").alias("_ginh")))
    rl = rl.join(g_inh, "run", "left")
    rl = rl.withColumn("_lcseq", C.longctx_seq_len(before, P["lc_tokens"], LC_START, LC_END))
    last_lc = (rl.filter(F.col("stage") == "lc_stage").groupBy("run")
               .agg(F.max_by("_lcseq", "step").alias("_aseq")))
    rl = rl.join(last_lc, "run", "left")
    seq = (F.when(F.col("stage") == "initial_stage", F.col("_iseq"))
           .when(F.col("stage") == "lc_stage", F.col("_lcseq")).otherwise(F.col("_aseq")))
    glob = F.when(F.col("stage") == "initial_stage", F.col("_ig")).otherwise(F.col("_ginh"))
    rl = rl.withColumn("seq_len", seq).withColumn("global_tokens", glob)
    rl = rl.withColumn("A", C.accum_steps(F.col("global_tokens"), MICRO, F.col("seq_len")))
    return materialize(rl.drop("_iseq", "_ig", "_ginh", "_lcseq", "_aseq"))


SQL_MICRO = SQL_RUN_LOG + f""",
rp AS (
  SELECT r.*, CAST(r.step - min(r.step) OVER (PARTITION BY r.run, r.stage) + 1 AS BIGINT) AS stage_step FROM run_log r
),
rp2 AS (SELECT *, CAST(stage_step * 256 AS BIGINT) AS stage_tokens, stage_step * 256 - 256 AS tb FROM rp),
ini AS (
  SELECT *, CASE WHEN tb < {FIRST} THEN {L0} ELSE {2 * L0} END AS i_seq,
            CAST(CASE WHEN tb < {FIRST} THEN {G0} WHEN tb < {SECOND} THEN {2 * G0} ELSE {4 * G0} END AS BIGINT) AS i_g,
            CAST(list_transform(range(6), lambda i: round_even({LC_START} + ({LC_END} - {LC_START}) * i / 5.0, 0))
                 [CAST(least(floor(tb / ({P['lc_tokens']} / 6.0)), 5) AS INTEGER) + 1] AS INTEGER) AS lc_seq
  FROM rp2
),
ginh AS (SELECT run, arg_max(i_g, step) AS g FROM ini WHERE stage = 'initial_stage' GROUP BY run),
alast AS (SELECT run, arg_max(lc_seq, step) AS s FROM ini WHERE stage = 'lc_stage' GROUP BY run),
micro AS (
  SELECT i.run, i.step, i.ts, i.loss, i.n, i.stage, i.tokens_processed, i.stage_step, i.stage_tokens,
         CASE WHEN i.stage = 'initial_stage' THEN i.i_seq WHEN i.stage = 'lc_stage' THEN i.lc_seq ELSE a.s END AS seq_len,
         CASE WHEN i.stage = 'initial_stage' THEN i.i_g ELSE g.g END AS global_tokens
  FROM ini i LEFT JOIN ginh g USING (run) LEFT JOIN alast a USING (run)
),
microA AS (SELECT *, CAST(ceil(global_tokens / ({MICRO} * seq_len)) AS INTEGER) AS A FROM micro)"""


@register("initial_shape", sql=with_ctes(SQL_MICRO, body=f"""
SELECT run, step, i_seq AS seq_len, i_g AS global_tokens FROM ini WHERE stage = 'initial_stage'"""))
def initial_shape(spark: SparkSession, sf: str) -> DataFrame:
    rl = C.stage_progress(run_log(spark, sf)).filter(F.col("stage") == "initial_stage")
    s = C.initial_shape(F.col("stage_tokens") - 256, L0, G0, FIRST, SECOND)
    return rl.select("run", "step", s["seq_len"].alias("seq_len"), s["global_tokens"].alias("global_tokens"))


@register("seqlen_milestones", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, CAST(i AS INTEGER) AS idx,
       CAST(round_even(lo + (hi - lo) * i / 5.0, 0) AS INTEGER) AS seq_len
FROM (SELECT run, CAST(min(n) AS BIGINT) AS lo, CAST(min(n) * 4 AS BIGINT) AS hi FROM run_log GROUP BY run),
     range(6) t(i)"""))
def seqlen_milestones(spark: SparkSession, sf: str) -> DataFrame:
    """Six milestones from each run's length n to 4n (half-to-even)."""
    rl = run_log(spark, sf).groupBy("run").agg(F.min("n").alias("lo"))
    m = rl.select("run", F.posexplode(C.seqlen_milestones(F.col("lo"), F.col("lo") * 4)).alias("idx", "seq_len"))
    return m.select("run", F.col("idx").cast("int").alias("idx"), "seq_len")


@register("longctx_shape", sql=with_ctes(SQL_MICRO, body="""
SELECT run, step, CAST(least(floor(tb / (100000 / 6.0)), 5) AS INTEGER) AS milestone_idx, lc_seq AS seq_len
FROM ini WHERE stage = 'lc_stage'"""))
def longctx_shape(spark: SparkSession, sf: str) -> DataFrame:
    rl = C.stage_progress(run_log(spark, sf)).filter(F.col("stage") == "lc_stage")
    before = F.col("stage_tokens") - 256
    return rl.select("run", "step", C.longctx_index(before, P["lc_tokens"]).alias("milestone_idx"),
                     C.longctx_seq_len(before, P["lc_tokens"], LC_START, LC_END).alias("seq_len"))


@register("anneal_shape", sql=with_ctes(SQL_MICRO, body="""
SELECT run, step, seq_len, global_tokens FROM microA WHERE stage = 'annealing_stage'"""))
def anneal_shape(spark: SparkSession, sf: str) -> DataFrame:
    """C4: annealing keeps the last long-context shape (as-of carry via a
    per-run ``max_by`` joined back, not a run-wide window)."""
    m = micro_log(spark, sf).filter(F.col("stage") == "annealing_stage")
    return m.select("run", "step", "seq_len", "global_tokens")


SQL_LR = f"""
lr_t AS (
  SELECT run, step, stage, stage_step, stage_tokens,
    CASE WHEN stage = 'initial_stage' THEN
           CASE WHEN stage_step - 1 < {P['warmup_steps']} THEN {P['peak_lr']} * (stage_step - 1) / {float(P['warmup_steps'])}
                ELSE {P['decay_lr_to']} + ({P['peak_lr']} - {P['decay_lr_to']}) * (0.5 * (1.0 + cos(pi() *
                     least(1.0, (stage_step - 1 - {P['warmup_steps']}) / {float(P['steps'] - P['warmup_steps'])})))) END
         WHEN stage = 'lc_stage' THEN {P['decay_lr_to']}
         ELSE {P['decay_lr_to']} - ({P['decay_lr_to']} - {P['anneal_decay_to']}) * least(1.0, (stage_tokens - 256) / {float(P['anneal_tokens'])})
    END AS lr
  FROM microA
)"""


def _lr(m: DataFrame) -> DataFrame:
    return m.withColumn("lr", C.stage_lr(F.col("stage"), F.col("stage_step") - 1, F.col("stage_tokens") - 256, P))


@register("lr_schedule", sql=with_ctes(SQL_MICRO, SQL_LR, body="""
SELECT run, step, stage, round(lr, 12) AS lr FROM lr_t"""))
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The LR logged at each row (counters before the update)."""
    m = _lr(micro_log(spark, sf))
    return m.select("run", "step", "stage", F.round("lr", 12).alias("lr"))


@register("lr_milestones", sql=with_ctes(SQL_MICRO, SQL_LR, body=f"""
SELECT run, step, stage, round(lr, 12) AS lr,
       CASE WHEN stage = 'initial_stage' AND stage_step - 1 < {P['warmup_steps']} THEN 'warmup'
            WHEN stage = 'initial_stage' THEN 'cosine decay'
            WHEN stage = 'lc_stage' THEN 'flat' ELSE 'linear anneal' END AS phase
FROM lr_t WHERE stage_step IN (1, 2, {P['warmup_steps']}, {P['warmup_steps'] + 1}, 500, 1000)"""))
def lr_milestones(spark: SparkSession, sf: str) -> DataFrame:
    """LR and phase label at milestone steps of each stage."""
    m = _lr(micro_log(spark, sf)).filter(F.col("stage_step").isin(1, 2, P["warmup_steps"], P["warmup_steps"] + 1, 500, 1000))
    phase = (F.when((F.col("stage") == "initial_stage") & (F.col("stage_step") - 1 < P["warmup_steps"]), F.lit("warmup"))
             .when(F.col("stage") == "initial_stage", F.lit("cosine decay"))
             .when(F.col("stage") == "lc_stage", F.lit("flat")).otherwise(F.lit("linear anneal")))
    return m.select("run", "step", "stage", F.round("lr", 12).alias("lr"), phase.alias("phase"))


@register("stage_complete", sql=with_ctes(SQL_MICRO, body=f"""
SELECT run, stage, CAST(count(*) FILTER (WHERE CASE WHEN stage = 'initial_stage' THEN stage_step >= {P['steps']}
        WHEN stage = 'lc_stage' THEN stage_tokens >= {P['lc_tokens']} ELSE stage_tokens >= {P['anneal_tokens']} END) AS BIGINT) AS complete_rows,
       min(step) FILTER (WHERE CASE WHEN stage = 'initial_stage' THEN stage_step >= {P['steps']}
        WHEN stage = 'lc_stage' THEN stage_tokens >= {P['lc_tokens']} ELSE stage_tokens >= {P['anneal_tokens']} END) AS first_complete_step
FROM microA GROUP BY run, stage"""))
def stage_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Per run and stage, where the completion predicate first holds."""
    m = micro_log(spark, sf).withColumn("done", C.stage_complete(F.col("stage"), F.col("stage_step"), F.col("stage_tokens"), P))
    return m.groupBy("run", "stage").agg(F.count_if("done").cast("long").alias("complete_rows"),
                                         F.min(F.when(F.col("done"), F.col("step"))).alias("first_complete_step"))


@register("stage_transitions", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, stage, CAST(min(step) - 1 AS BIGINT) AS entry_step FROM run_log WHERE stage <> 'initial_stage' GROUP BY run, stage
UNION ALL
SELECT run, 'complete', CAST(max(step) AS BIGINT) FROM run_log GROUP BY run"""))
def stage_transitions(spark: SparkSession, sf: str) -> DataFrame:
    from pressline.operators.runlog import transitions

    return transitions(run_log(spark, sf)).select("run", "stage", F.col("entry_step").cast("long"))


@register("accum_steps", sql=with_ctes(SQL_MICRO, body="""
SELECT run, stage, seq_len, global_tokens, A, CAST(count(*) AS BIGINT) AS micro_steps
FROM microA GROUP BY run, stage, seq_len, global_tokens, A"""))
def accum_steps(spark: SparkSession, sf: str) -> DataFrame:
    m = micro_log(spark, sf)
    return m.groupBy("run", "stage", "seq_len", "global_tokens", "A").agg(F.count(F.lit(1)).alias("micro_steps"))


@register("safe_batch", sql=with_ctes(SQL_MICRO, body="""
SELECT run, step, CAST(greatest(1, trunc(CAST(A * 8 AS DOUBLE) * 0.85)) AS INTEGER) AS safe_micro
FROM microA"""))
def safe_batch(spark: SparkSession, sf: str) -> DataFrame:
    """C14: ``max(1, int(x * 0.85))`` applied to 8 A (a probed batch size)."""
    m = micro_log(spark, sf)
    return m.select("run", "step", C.safe_batch(F.col("A") * 8).alias("safe_micro"))


@register("token_counters", sql=with_ctes(SQL_MICRO, body="""
SELECT run, step, stage,
       CAST(sum(seq_len) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_tokens,
       CAST(sum(seq_len) OVER (PARTITION BY run, stage ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stage_tokens_run
FROM microA"""))
def token_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Running tokens (micro-step tokens = seq_len) per run and per (run, stage)."""
    from pressline.operators.ordered import prefix_sums

    m = micro_log(spark, sf).select("run", "step", "stage", "seq_len")
    m = prefix_sums(m, "step", {"total_tokens": F.col("seq_len").cast("long")}, by=["run"], inclusive=True)
    m = prefix_sums(m, "step", {"stage_tokens_run": F.col("seq_len").cast("long")}, by=["run", "stage"], inclusive=True)
    return m.select("run", "step", "stage", "total_tokens", "stage_tokens_run")


@register("shape_changes", sql=with_ctes(SQL_MICRO, body="""
SELECT run, step, seq_len, global_tokens FROM (
  SELECT *, lag(seq_len) OVER w AS ps, lag(global_tokens) OVER w AS pg FROM microA
  WINDOW w AS (PARTITION BY run ORDER BY step)) t
WHERE ps IS NULL OR ps IS DISTINCT FROM seq_len OR pg IS DISTINCT FROM global_tokens"""))
def shape_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows where seq_len or global batch differs from the previous row."""
    m = C.change_rows(micro_log(spark, sf), ["run"], "step", ["seq_len", "global_tokens"])
    return m.filter("changed").select("run", "step", "seq_len", "global_tokens")


@register("cadence", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, step, stage FROM run_log WHERE step % 200 = 0"""))
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    """P10: every 200th update triggers validation and a checkpoint."""
    from pressline.functions.fixed import CADENCE

    return run_log(spark, sf).filter(F.col("step") % CADENCE == 0).select("run", "step", "stage")


SQL_ACCUM = SQL_MICRO + """,
chg AS (
  SELECT *, CASE WHEN lag(stage) OVER w IS NULL OR lag(stage) OVER w <> stage OR lag(seq_len) OVER w <> seq_len
                  OR lag(global_tokens) OVER w <> global_tokens THEN 1 ELSE 0 END AS changed
  FROM microA WINDOW w AS (PARTITION BY run ORDER BY step)
),
ses AS (SELECT *, sum(changed) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM chg),
ses2 AS (SELECT *, step - min(step) OVER (PARTITION BY run, session) + 1 AS rn FROM ses),
grp AS (
  SELECT run, stage, session, (rn - 1) // A AS g, sum(loss / A) AS gl, count(*) AS taken, max(A) AS A,
         min(step) AS first_step, max(step) AS last_step
  FROM ses2 GROUP BY run, stage, session, (rn - 1) // A
),
ss AS (
  SELECT run, stage, session, count(*) FILTER (WHERE taken = A) AS complete,
         coalesce(sum(gl) FILTER (WHERE taken < A), 0.0) AS lft
  FROM grp GROUP BY run, stage, session
),
ss2 AS (
  SELECT *, sum(CASE WHEN complete > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, stage ORDER BY session
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cin
  FROM ss
),
ss3 AS (SELECT *, sum(lft) OVER (PARTITION BY run, stage, cin ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS runl FROM ss2),
ss4 AS (
  SELECT *, coalesce(lag(runl) OVER (PARTITION BY run, stage ORDER BY session), 0.0) AS carry,
         session = max(session) OVER (PARTITION BY run, stage) AS is_last
  FROM ss3
),
ups AS (
  SELECT g.run, g.stage, g.session, g.first_step, g.last_step, g.taken, g.A,
         g.gl + CASE WHEN g.g = 0 THEN s.carry ELSE 0.0 END AS loss, false AS flushed
  FROM grp g JOIN ss4 s USING (run, stage, session) WHERE g.taken = g.A
  UNION ALL
  SELECT g.run, g.stage, g.session, g.first_step, g.last_step, g.taken, g.A,
         (g.gl + CASE WHEN s.complete = 0 THEN s.carry ELSE 0.0 END) * g.A / g.taken, true
  FROM grp g JOIN ss4 s USING (run, stage, session) WHERE g.taken < g.A AND s.is_last
),
upd AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY last_step) AS upd FROM ups)"""


@register("accumulate", sql=with_ctes(SQL_ACCUM, body="""
SELECT run, CAST(upd AS BIGINT) AS "update", stage, first_step, last_step, CAST(taken AS BIGINT) AS taken,
       round(loss, 9) AS loss, flushed
FROM upd"""))
def accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-steps grouped into optimizer updates (with the stage-end flush)."""
    u = C.accumulate(micro_log(spark, sf))
    return u.select("run", "update", "stage", "first_step", "last_step", F.col("taken").cast("long"),
                    F.round("loss", 9).alias("loss"), "flushed")


@register("flush_partial", sql=with_ctes(SQL_ACCUM, body="""
SELECT run, stage, last_step, CAST(taken AS BIGINT) AS taken, A, round(loss, 9) AS loss FROM upd WHERE flushed"""))
def flush_partial(spark: SparkSession, sf: str) -> DataFrame:
    """The partial group closed at each stage's end, loss scaled by A / taken."""
    u = C.accumulate(micro_log(spark, sf)).filter("flushed")
    return u.select("run", "stage", "last_step", F.col("taken").cast("long"), "A", F.round("loss", 9).alias("loss"))
