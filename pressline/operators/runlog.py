"""Run-log metrics: smoothing, EMA, intervals, ETA, markers, ticks, overlays.

All windows over a run are bounded: running values use the two-level scans of
``pressline.operators.ordered``; frames are differences of running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.fixed import BOUNDARY_LABELS, SMOOTH_DIVISOR, SMOOTH_MAX_WINDOW, SMOOTH_MIN_WINDOW
from pressline.operators.ordered import ema as _ema
from pressline.operators.ordered import join_null_safe, lag_by_step, prefix_sums
from pressline.session import materialize_table


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def smoothing_window(n: Column) -> Column:
    """``min(100, max(2, n // 10))``."""
    return F.least(F.lit(SMOOTH_MAX_WINDOW), F.greatest(F.lit(SMOOTH_MIN_WINDOW), F.floor(n / SMOOTH_DIVISOR))).cast("int")


def moving_average(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step", value: str = "loss",
                   out: str = "smoothed") -> DataFrame:
    """M4: full-window moving average of window ``w`` per run, placed at offset
    ``(w - 1) // 2``; runs with ``n < 2`` or ``n < w`` give nothing.

    ``step`` is dense 1..n; the window size follows the run's length. A frame's
    sum is the difference of two running totals, looked up at the frame's ends
    by equi-joins on (run, step): one plan for all window sizes, and no task
    holds a run. NaN and infinities are counted beside the totals, so that they
    reach the frames they stand in and no others; a frame with a null gives
    nothing.
    """
    by = list(by)
    n = log.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_w", smoothing_window(F.col("_n"))).filter((F.col("_n") > 1) & (F.col("_n") >= F.col("_w")))
    v, inf = F.col(value).cast("double"), F.lit(float("inf"))
    odd = {"_nan": F.isnan(v), "_pos": v == inf, "_neg": v == -inf}
    plain = F.when(~(odd["_nan"] | odd["_pos"] | odd["_neg"]), v).otherwise(0.0)
    totals = {"_s": plain, "_k": v.isNotNull().cast("long"), **{k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in odd.items()}}
    t = materialize_table(prefix_sums(join_null_safe(log, n, by), step, totals, by=by, inclusive=True), "run-totals")
    names = list(totals)
    before = F.floor((F.col("_w") - 1) / 2)
    after = F.col("_w") - 1 - before
    t0 = (t.drop(*names).withColumn("_hi", F.col(step) + after).withColumn("_lo", F.col(step) - before - 1)
          .filter((F.col("_lo") >= 0) & (F.col("_hi") <= F.col("_n"))))
    at = lambda end: t.select(*by, F.col(step).alias(end), *[F.col(x).alias(end + x) for x in names])
    h = join_null_safe(join_null_safe(t0, at("_hi"), [*by, "_hi"]), at("_lo"), [*by, "_lo"], "left")
    got = {x: F.col("_hi" + x) - F.coalesce(F.col("_lo" + x), F.lit(0)) for x in names}
    h = h.filter(got["_k"] == F.col("_w"))
    mean = (F.when((got["_nan"] > 0) | ((got["_pos"] > 0) & (got["_neg"] > 0)), F.lit(float("nan")))
            .when(got["_pos"] > 0, inf).when(got["_neg"] > 0, -inf).otherwise(got["_s"] / F.col("_w")))
    return h.withColumn(out, mean).drop("_hi", "_lo", "_n", *["_hi" + x for x in names], *["_lo" + x for x in names])


def ema(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step", value: str = "loss",
        out: str = "ema", alpha: float = 0.1) -> DataFrame:
    """M6: ``e1 = v1``, ``e = a v + (1 - a) e`` per run (a scan of affine maps)."""
    return _ema(log, list(by), step, value, out, alpha)


def step_interval(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step", ts: str = "ts",
                  divisor: int = 1) -> DataFrame:
    """M7: seconds since the previous row of the run, divided by ``divisor``
    (rows spanned; the reference divides by its print interval)."""
    t = lag_by_step(log, list(by), step, {"_pts": ts})
    secs = (_micros(F.col(ts)) - _micros(F.col("_pts"))) / F.lit(1e6)
    return t.withColumn("interval_sec", secs / F.lit(float(divisor))).drop("_pts")


def throughput_eta(log: DataFrame, targets: dict[str, int], by: Sequence[str] = ("run",),
                   ts: str = "ts") -> DataFrame:
    """M8: rate = done / elapsed since the stage's first timestamp; ETA =
    remaining / rate truncated to seconds and floored at 0; 0 when nothing
    is done. Initial stage counts steps, later stages count tokens.
    ``log`` needs ``stage``, ``stage_step`` and ``stage_tokens``."""
    by = list(by)
    first = log.groupBy(*by, "stage").agg(F.min(ts).alias("_t0"))
    t = log.join(first, on=[*by, "stage"])
    elapsed = (_micros(F.col(ts)) - _micros(F.col("_t0"))) / F.lit(1e6)
    done = F.when(F.col("stage") == "initial_stage", F.col("stage_step")).otherwise(F.col("stage_tokens"))
    target = F.when(F.col("stage") == "initial_stage", F.lit(targets["initial_stage"])) \
        .when(F.col("stage") == "lc_stage", F.lit(targets["lc_stage"])).otherwise(F.lit(targets["annealing_stage"]))
    rate = done / elapsed
    eta = F.when((done == 0) | (elapsed <= 0), F.lit(0)).otherwise(
        F.floor(F.greatest((target - done) / rate, F.lit(0.0))))
    return t.withColumn("elapsed_sec", elapsed).withColumn("rate", F.when(elapsed > 0, rate)) \
        .withColumn("eta_sec", eta.cast("long")).drop("_t0")


def transitions(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """The update count on entering each later stage (first step - 1) and
    at completion (last step)."""
    by = list(by)
    firsts = log.groupBy(*by, "stage").agg(F.min(step).alias("_f"), F.max(step).alias("_l"))
    entry = firsts.filter(F.col("stage") != "initial_stage").select(*by, "stage", (F.col("_f") - 1).alias("entry_step"))
    done = log.groupBy(*by).agg(F.max(step).alias("entry_step")).withColumn("stage", F.lit("complete"))
    return entry.unionByName(done.select(*by, "stage", "entry_step"))


def stage_markers(log: DataFrame, warmup_steps: int, by: Sequence[str] = ("run",), step: str = "step",
                  start_step: Column | None = None) -> DataFrame:
    """M9: labelled boundaries that are non-zero and inside the plotted range."""
    by = list(by)
    tr = transitions(log, by, step)
    label = F.lit(None).cast("string")
    for stage in ("lc_stage", "annealing_stage", "complete"):
        label = F.when(F.col("stage") == stage, F.lit(BOUNDARY_LABELS[stage])).otherwise(label)
    marks = tr.select(*by, label.alias("label"), F.col("entry_step").alias("step"))
    runs = log.groupBy(*by).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    warm = runs.select(*by, F.lit(BOUNDARY_LABELS["warmup"]).alias("label"), F.lit(warmup_steps).cast("long").alias("step"))
    allm = marks.unionByName(warm).join(runs, on=by)
    return allm.filter((F.col("step") != 0) & F.col("step").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def tick_union(log: DataFrame, every: int, by: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """Axis ticks (multiples of ``every``) united with the explicit
    stage-entry and final steps; nulls dropped, clipped to the range,
    distinct and sorted."""
    by = list(by)
    auto = log.filter(F.col(step) % every == 0).select(*by, F.col(step).alias("tick"))
    tr = transitions(log, by, step).filter(F.col("stage").isin("lc_stage", "annealing_stage", "complete"))
    explicit = tr.select(*by, F.col("entry_step").alias("tick")).filter(F.col("tick").isNotNull())
    runs = log.groupBy(*by).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    u = auto.union(explicit).distinct().join(runs, on=by)
    return u.filter(F.col("tick").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi").orderBy(*by, "tick")


def val_clip(val: DataFrame, log: DataFrame, by: Sequence[str] = ("run",), step: str = "step") -> DataFrame:
    """The validation points inside the plotted range, ``num_updates - n + 1
    .. num_updates`` for a history of ``n`` updates up to ``num_updates`` (the
    log of a resumed run holds its later updates only)."""
    by = list(by)
    hi, n = F.max(step).alias("_hi"), F.count(F.lit(1)).alias("_n")
    t = join_null_safe(val, log.groupBy(*by).agg(hi, n), by)
    return t.filter(F.col(step).between(F.col("_hi") - F.col("_n") + 1, F.col("_hi"))).drop("_hi", "_n")


def clock(seconds: Column) -> Column:
    """Whole seconds as ``[D day[s], ]H:MM:SS``."""
    days, s = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    time = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), time)).otherwise(time)


def grouped(n: Column, digits: int = 1) -> Column:
    """An integer with thousands separators, zero-padded to ``digits`` digits first."""
    s = n.cast("string")
    padded = F.when(F.length(s) < digits, F.lpad(s, digits, "0")).otherwise(s)
    return F.regexp_replace(padded, r"(?<=\d)(?=(\d{3})+$)", ",")


def two_places(x: Column) -> Column:
    """Rounded to hundredths, halves up, of a value known to nine places."""
    return F.floor(F.round(x, 9) * 100 + 0.5) / 100


def log_line(log: DataFrame, steps: int, tokens: dict[str, int], by: Sequence[str] = ("run",), alpha: float = 0.1) -> DataFrame:
    """The status line of every update, as column ``line``:

    ``[MM-dd HH:mm:ss] | num_grad_updates: n | Step: x/y | Tokens: x/y |
    Avg Time: s | Elapsed: t | ETA: t | LR: r | Loss: l``.

    ``steps`` is the initial stage's step target, ``tokens`` the stages' token
    targets. The step block is blank after the initial stage; tokens are padded
    to the initial target's width; the average time is the moving average of
    the seconds between updates (0 for a run's first); elapsed counts from the
    run's first row, ETA from the stage's. ``log`` has step, ts, stage,
    stage_step, stage_tokens, lr and loss."""
    by = list(by)
    t = throughput_eta(log, {**tokens, "initial_stage": steps}, by)
    t = _ema(step_interval(t, by), by, "step", "interval_sec", "_avg", alpha)
    t = join_null_safe(t, log.groupBy(*by).agg(F.min("ts").alias("_run0")), by)
    target = F.lit(None).cast("long")
    for stage, n in tokens.items():
        target = F.when(F.col("stage") == stage, F.lit(n).cast("long")).otherwise(target)
    wide = len(str(steps))
    step = F.when(F.col("stage") == "initial_stage", F.format_string(f"Step: %{wide}d/%d", F.col("stage_step"), F.lit(steps))).otherwise(
        F.lit(" " * len(f"Step: {steps}/{steps}")))
    done = F.concat(grouped(F.col("stage_tokens"), len(str(tokens["initial_stage"]))), F.lit("/"), grouped(target))
    elapsed = F.floor((_micros(F.col("ts")) - _micros(F.col("_run0"))) / F.lit(1e6))
    line = F.format_string(
        f"[%s] | num_grad_updates: %{wide}d | %s | Tokens: %s | Avg Time: %5.2fs | Elapsed: %8s | ETA: %8s | LR: %15.8f | Loss: %7.4f",
        F.date_format("ts", "MM-dd HH:mm:ss"), F.col("step"), step, done, two_places(F.col("_avg")), clock(elapsed),
        clock(F.col("eta_sec")), F.col("lr"), F.col("loss"))
    return t.withColumn("line", line).drop("_avg", "_run0")
