"""Shape and learning-rate schedules as column expressions over a log table.

Each function maps progress columns (steps completed, tokens processed) to the
value the schedule gives; nothing simulates a training run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.fixed import N_MILESTONES, SAFE_BATCH_FACTOR
from pressline.operators.ordered import lag_by_step, prefix_sums
from pressline.session import materialize


def initial_shape(tokens: Column, L0: int, G0: int, first: int, second: int) -> Column:
    """(seq_len, global_tokens): (L0, G0) below ``first`` tokens, then
    (2 L0, 2 G0) below ``second``, then (2 L0, 4 G0)."""
    return (F.when(tokens < first, F.struct(F.lit(L0).alias("seq_len"), F.lit(G0).cast("long").alias("global_tokens")))
            .when(tokens < second, F.struct(F.lit(2 * L0).alias("seq_len"), F.lit(2 * G0).cast("long").alias("global_tokens")))
            .otherwise(F.struct(F.lit(2 * L0).alias("seq_len"), F.lit(4 * G0).cast("long").alias("global_tokens"))))


def seqlen_milestones(start: Column | int, end: Column | int, n: int = N_MILESTONES) -> Column:
    """``round(start + (end - start) * i / (n - 1))``, half to even."""
    s = F.lit(start) if isinstance(start, int) else start
    e = F.lit(end) if isinstance(end, int) else end
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.bround(s + (e - s) * i / F.lit(float(n - 1)), 0).cast("int"))


def longctx_index(tokens: Column, budget: Column | int, n: int = N_MILESTONES) -> Column:
    """``min(int(tokens // (budget / n)), n - 1)`` with a float division."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.least(F.floor(tokens / (b.cast("double") / F.lit(float(n)))), F.lit(n - 1)).cast("int")


def longctx_seq_len(tokens: Column, budget: Column | int, start: int, end: int) -> Column:
    return F.element_at(seqlen_milestones(start, end), longctx_index(tokens, budget) + 1)


def lr_warmup_cosine(steps_done: Column, warmup: int, steps: int, peak: float, floor_lr: float) -> Column:
    """Linear warm-up then cosine decay to ``floor_lr`` (progress clamped at 1)."""
    warm = F.lit(peak) * steps_done.cast("double") / F.lit(float(max(1, warmup)))
    prog = F.least(F.lit(1.0), (steps_done - F.lit(warmup)).cast("double") / F.lit(float(max(1, steps - warmup))))
    cosine = F.lit(floor_lr) + F.lit(peak - floor_lr) * (F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * prog)))
    return F.when(steps_done < warmup, warm).otherwise(cosine)


def lr_flat(min_lr: float) -> Column:
    """Constant at the initial stage's floor."""
    return F.lit(min_lr)


def lr_linear_anneal(tokens: Column, budget: int, min_lr: float, target: float) -> Column:
    """``min_lr - (min_lr - target) * min(1, tokens / max(1, budget))``."""
    prog = F.least(F.lit(1.0), tokens.cast("double") / F.lit(float(max(1, budget))))
    return F.lit(min_lr) - F.lit(min_lr - target) * prog


def stage_lr(stage: Column, steps_done: Column, stage_tokens: Column, p: dict) -> Column:
    """C5-C7 by stage (the LR logged for an update is computed from the
    counters *before* that update increments them)."""
    return (F.when(stage == "initial_stage",
                   lr_warmup_cosine(steps_done, p["warmup_steps"], p["steps"], p["peak_lr"], p["decay_lr_to"]))
            .when(stage == "lc_stage", lr_flat(p["decay_lr_to"]))
            .otherwise(lr_linear_anneal(stage_tokens, p["anneal_tokens"], p["decay_lr_to"], p["anneal_decay_to"])))


def stage_complete(stage: Column, steps_done: Column, stage_tokens: Column, p: dict) -> Column:
    """Initial: steps done >= steps; other stages: tokens >= budget."""
    return (F.when(stage == "initial_stage", steps_done >= p["steps"])
            .when(stage == "lc_stage", stage_tokens >= p["lc_tokens"])
            .otherwise(stage_tokens >= p["anneal_tokens"]))


def accum_steps(global_tokens: Column, micro: Column | int, seq_len: Column) -> Column:
    """C11: ``ceil(global_tokens / (micro * seq_len))``."""
    m = F.lit(micro) if isinstance(micro, int) else micro
    return F.ceil(global_tokens / (m * seq_len)).cast("int")


def safe_batch(x: Column) -> Column:
    """C14: ``max(1, int(x * 0.85))``."""
    return F.greatest(F.lit(1), (x * F.lit(SAFE_BATCH_FACTOR)).cast("int"))


# ------------------------------------------------------------------ log-level operators


def stage_progress(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step",
                   tokens_per_step: Column | None = None) -> DataFrame:
    """Adds ``stage_step`` (1-based within the stage) and ``stage_tokens``
    (tokens of the stage up to and including the row), from a per-(run,
    stage) start table -- one small aggregate joined back, no run-wide window."""
    by = list(by)
    starts = log.groupBy(*by, "stage").agg(F.min(step).alias("_s0"))
    t = log.join(starts, on=[*by, "stage"])
    t = t.withColumn("stage_step", F.col(step) - F.col("_s0") + 1).drop("_s0")
    tps = tokens_per_step if tokens_per_step is not None else F.lit(256)
    return t.withColumn("stage_tokens", (F.col("stage_step") * tps).cast("long"))


def change_rows(log: DataFrame, by: Sequence[str], step: str, cols: Sequence[str]) -> DataFrame:
    """Flag rows where any of ``cols`` differs from the previous row
    (the first row of a group counts as a change). Null-safe comparison."""
    prev = {f"_prev_{c}": c for c in cols}
    t = lag_by_step(log, by, step, prev)
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"_prev_{c}").eqNullSafe(F.col(c))
    first = F.col(f"_prev_{cols[0]}").isNull() & (F.col(step) == 1)
    return t.withColumn("changed", changed | first).drop(*prev)


def sessions(log: DataFrame, by: Sequence[str], step: str, cols: Sequence[str]) -> DataFrame:
    """Session id = running count of change rows (distributed running sum)."""
    t = change_rows(log, by, step, cols)
    return prefix_sums(t, step, {"session": F.col("changed").cast("long")}, by=by, inclusive=True)


def accumulate(micro: DataFrame, by: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """Group micro-steps into optimizer updates.

    Input rows are micro-steps with ``stage``, ``seq_len``, ``global_tokens``,
    ``A`` (accumulation steps) and ``loss``. A session is a run of rows with
    the same (stage, seq_len, global_tokens); the counter restarts in each.
    An update fires every ``A`` micro-steps with loss ``sum(loss / A)``.
    Rows left over at a shape change inside a stage are not flushed: their
    loss is carried into the next update of that stage. At a stage's end a
    partial group is flushed with loss ``running * A / taken``.
    Returns one row per update with ``update`` (1-based within the run).
    """
    by = list(by)
    t = sessions(micro, by, step, ["stage", "seq_len", "global_tokens"])
    s_first = t.groupBy(*by, "session").agg(F.min(step).alias("_sf"))
    t = t.join(s_first, on=[*by, "session"])
    t = t.withColumn("_rn", F.col(step) - F.col("_sf") + 1)
    t = t.withColumn("_grp", F.floor((F.col("_rn") - 1) / F.col("A")).cast("long"))
    groups = materialize(t.groupBy(*by, "stage", "session", "_grp").agg(
        F.sum(F.col("loss") / F.col("A")).alias("_loss"), F.count(F.lit(1)).alias("taken"),
        F.max("A").alias("A"), F.min(step).alias("first_step"), F.max(step).alias("last_step")))
    # session summary (small: one row per shape change)
    ss = groups.groupBy(*by, "stage", "session").agg(
        F.max("A").alias("A"),
        F.count_if(F.col("taken") == F.col("A")).alias("_complete"),
        F.sum(F.when(F.col("taken") < F.col("A"), F.col("_loss")).otherwise(F.lit(0.0))).alias("_left"))
    ws = Window.partitionBy(*by, "stage").orderBy("session")
    # carry into a session = leftovers since (and including) the last session
    # with complete groups: a running sum of leftovers restarted after each
    # complete session, read at the previous session
    ss = ss.withColumn("_cin", F.sum(F.when(F.col("_complete") > 0, 1).otherwise(0)).over(
        ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wc = Window.partitionBy(*by, "stage", "_cin").orderBy("session").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ss = ss.withColumn("_run", F.sum("_left").over(wc))
    ss = ss.withColumn("_carry", F.coalesce(F.lag("_run", 1).over(ws), F.lit(0.0)))
    last_sess = F.max("session").over(Window.partitionBy(*by, "stage"))
    ss = ss.withColumn("_is_last", F.col("session") == last_sess)
    g = groups.join(ss.select(*by, "stage", "session", "_carry", "_is_last", "_complete"),
                    on=[*by, "stage", "session"])
    complete = g.filter(F.col("taken") == F.col("A")).withColumn(
        "loss", F.col("_loss") + F.when(F.col("_grp") == 0, F.col("_carry")).otherwise(F.lit(0.0))
    ).withColumn("flushed", F.lit(False))
    # flush at the stage's end: the partial group of the last session
    flush = g.filter((F.col("taken") < F.col("A")) & F.col("_is_last")).withColumn(
        "loss", (F.col("_loss") + F.when(F.col("_complete") == 0, F.col("_carry")).otherwise(F.lit(0.0)))
        * F.col("A") / F.col("taken")
    ).withColumn("flushed", F.lit(True))
    ups = complete.unionByName(flush).select(*by, "stage", "session", "first_step", "last_step", "taken", "A",
                                             "loss", "flushed")
    ups = prefix_sums(ups, "last_step", {"update": F.lit(1).cast("long")}, by=by, inclusive=True)
    return ups
