"""Evaluation operators on request and logits tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.fixed import EOD_ID, EVAL_STAGES_WITH_TASKS, EVAL_TASK_SPEC


def length_guard(df: DataFrame, start_pos: Column, seq_len: Column, window: int) -> DataFrame:
    """``fits`` is false when ``start_pos + seq_len`` exceeds the window."""
    return df.withColumn("fits", (start_pos + seq_len) <= F.lit(window))


# ------------------------------------------------------------------ logits maths


def log_softmax_at(logits: Column, idx: Column) -> Column:
    """``log_softmax(logits)[idx]`` (0-based idx), max-shifted for stability."""
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return F.element_at(logits, idx + 1) - lse


def argmax(logits: Column) -> Column:
    """0-based index of the largest logit (lowest index on ties)."""
    return F.array_position(logits, F.array_max(logits)) - 1


def cross_entropy(df: DataFrame, by: list[str], logits: str = "logits", target: str = "target",
                  pad_id: int = 0) -> DataFrame:
    """M1: mean over non-pad targets of ``logsumexp - logit[target]``."""
    t = df.filter(F.col(target) != pad_id)
    return t.groupBy(*by).agg(F.avg(-log_softmax_at(F.col(logits), F.col(target))).alias("loss"),
                              F.count(F.lit(1)).alias("tokens"))


# ------------------------------------------------------------------ context fitting


def fit_context(ctx: Column, cont: Column, max_len: int) -> tuple[Column, Column]:
    """room = max - len(cont); room < 1 keeps cont[:max-1] and ctx[-1:];
    else ctx keeps its last ``room`` ids when longer."""
    room = F.lit(max_len) - F.size(cont)
    new_cont = F.when(room < 1, F.slice(cont, 1, max_len - 1)).otherwise(cont)
    tail_room = F.slice(ctx, F.greatest(F.size(ctx) - room, F.lit(0)) + 1, F.greatest(room, F.lit(1)))
    new_ctx = (F.when(room < 1, F.slice(ctx, -1, 1))
               .when(F.size(ctx) > room, tail_room)
               .otherwise(ctx))
    return new_ctx, new_cont


def clamp_prompt(ids: Column, max_tokens: Column, max_len: int) -> tuple[Column, Column]:
    """E5: a prompt of ``>= max_len`` ids keeps its last ``max_len - 1``;
    ``max_tokens`` shrinks so prompt + output fit."""
    new_ids = F.when(F.size(ids) >= max_len,
                     F.slice(ids, F.size(ids) - (max_len - 1) + 1, max_len - 1)).otherwise(ids)
    new_max = F.when(F.size(new_ids) + max_tokens > max_len, F.lit(max_len) - F.size(new_ids)).otherwise(max_tokens)
    return new_ids, new_max


def cut_at_eod(ids: Column, max_tokens: Column) -> Column:
    """The emitted ids end before the first EOD and number at most
    ``max_tokens - 1``."""
    p = F.array_position(ids, EOD_ID)
    upto = F.when(p == 0, F.size(ids)).otherwise(p - 1)
    return F.slice(ids, 1, F.greatest(F.least(upto, max_tokens - 1), F.lit(0)))


def cut_at_stop(text: Column, stops: Column) -> Column:
    """Cut at the earliest occurrence of any stop string (a bare string
    is promoted to a one-element list by the caller)."""
    pos = F.array_min(F.filter(F.transform(stops, lambda s: F.instr(text, s)), lambda p: p > 0))
    return F.when(pos.isNull(), text).otherwise(F.substring(text, F.lit(1), pos - 1))


# ------------------------------------------------------------------ task selection


def eval_tasks(stage: Column) -> Column:
    """The benchmark spec for a stage; long-context raises."""
    return (F.when(stage.isin(*EVAL_STAGES_WITH_TASKS), F.lit(EVAL_TASK_SPEC))
            .when(stage == "lc_stage", F.raise_error(F.lit("long-context benchmarks are not implemented")))
            .otherwise(F.raise_error(F.concat(F.lit("no benchmarks for stage "), stage))))


def parse_task_spec(df: DataFrame, spec: str = "spec") -> DataFrame:
    """``"gsm8k|5,math|4"`` -> one row per (task, n_shot)."""
    t = df.withColumn("_t", F.explode(F.split(F.col(spec), ",")))
    return (t.withColumn("task", F.split_part(F.col("_t"), F.lit("|"), F.lit(1)))
             .withColumn("n_shot", F.split_part(F.col("_t"), F.lit("|"), F.lit(2)).cast("int"))
             .drop("_t"))


def limit_per_task(df: DataFrame, n: int | None, task: str = "task", order: str = "item") -> DataFrame:
    """At most ``n`` samples per task (``None`` = all). Planned as a
    window group limit: each task keeps a running top-n before the shuffle."""
    if n is None:
        return df
    from pyspark.sql import Window

    w = Window.partitionBy(task).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
