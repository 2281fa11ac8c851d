"""Range source, packer restarts, and the run monitor's state."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressline.plans.q_streaming import run_to_end
from pressline.streaming import monitor, packer
from pressline.streaming.ranges import key_cuts, range_number, rows_of


def test_ranges_hold_every_row_once(spark):
    rows = [(i * 977 % 1009,) for i in range(500)] + [(None,)]
    t = spark.createDataFrame(rows, "k long")
    cuts = key_cuts(t, "k", 7)
    bounds = [None, *cuts, None]
    each = [rows_of(t, "k", a, b).collect() for a, b in zip(bounds, bounds[1:])]
    assert sorted(r.k or -1 for e in each for r in e) == sorted((r[0] or -1 for r in rows))
    numbers = {r.k: r.n for r in t.where("k is not null").select("k", range_number("k", cuts).alias("n")).collect()}
    assert all(numbers[r.k] == i for i, e in enumerate(each) for r in e if r.k is not None)


def test_packer_reads_ranges_once_and_ends(spark, tmp_path):
    n = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("n"))
    cuts = key_cuts(n, "doc_id", 10)
    out, state, work = packer.run_stream_pack(spark, n, 50, 200, 10, cuts=cuts, end=1, work=f"{tmp_path}/w")
    assert spark.read.parquet(out).count() <= 11
    packer.run_stream_pack(spark, n, 50, 200, 10, cuts=cuts, work=work)
    rows = spark.read.parquet(out)
    ids = [r.doc_id for r in rows.collect()]
    assert len(ids) == len(set(ids)) < 100  # no document twice, none far behind the budgets
    assert rows.agg(F.sum("val_take"), F.sum("train_take")).first() == (50, 200)
    last = packer.stream_state(spark, state).orderBy(F.desc("batch_id")).first()
    assert last.done and last.train_written == 200
    # a restart with nothing left ends at once and changes nothing
    packer.run_stream_pack(spark, n, 50, 200, 10, cuts=cuts, work=work)
    assert spark.read.parquet(out).count() == len(ids)


def _log(run, n, start=0.0):
    rng = np.random.default_rng(abs(hash(run)) % 1000)
    at = start + np.cumsum(rng.uniform(0.1, 2, n))
    stage = np.where(np.arange(n) < n // 2, "initial_stage", "lc_stage")
    first = np.where(stage == "initial_stage", 0, n // 2)
    return pd.DataFrame({"run": run, "step": np.arange(1, n + 1), "seconds": at, "loss": rng.uniform(1, 9, n), "stage": stage,
                         "stage_step": np.arange(n) - first + 1, "stage_tokens": (np.arange(n) - first + 1) * 256})


def _expected(log, targets):
    out = {}
    for run, t in log.groupby("run"):
        t = t.sort_values("step")
        ema = monitor.averaged(t.loss.to_numpy(), None, 0.1)
        avg = monitor.averaged(np.diff(t.seconds, prepend=t.seconds.iloc[0]), None, 0.1)
        begin = t.groupby("stage").seconds.transform("min")
        for i, (s, e, a, el, st, ss, tok) in enumerate(zip(t.step, ema, avg, t.seconds - begin, t.stage, t.stage_step, t.stage_tokens)):
            done = ss if st == "initial_stage" else tok
            eta = int(max((targets[st] - done) / (done / el), 0)) if el > 0 else 0
            out[run, s] = (e, a, el, eta)
    return out


def test_monitor_over_restarts_and_disorder(spark, tmp_path):
    """Rows out of order and twice, over three queries on one checkpoint."""
    targets = {"initial_stage": 500, "lc_stage": 50_000}
    log = pd.concat([_log("a", 300), _log("b", 41, 1e9)])
    mixed = log.sample(frac=1, random_state=3)
    parts = [log[log.step <= 20], pd.concat([mixed[mixed.step.between(31, 100)], log[log.step == 5]]), mixed[(mixed.step > 100) | mixed.step.between(21, 30)]]
    src = f"{tmp_path}/src"
    for part in parts:
        spark.createDataFrame(part, monitor.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run_to_end(monitor.run_monitor(spark.readStream.schema(monitor.LOG_SCHEMA).parquet(src), targets), f"{tmp_path}/work")
    got = spark.read.parquet(f"{tmp_path}/work/out").collect()
    want = _expected(log, targets)
    assert len(got) == len(want) == len(log)
    for r in got:
        e, a, el, eta = want[r.run, r.step]
        assert (r.ema, r.avg_time, r.elapsed_sec) == pytest.approx((e, a, el), abs=1e-5) and r.eta_sec == eta
        assert (r.rate is None) == (el <= 0)


def test_monitor_gives_up_on_a_gap(spark, tmp_path):
    """A live stream: step 3 never comes, its timer lets the others pass."""
    import time

    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    log, src = _log("a", 6), f"{tmp_path}/src"
    spark.createDataFrame(log[log.step != 3], monitor.LOG_SCHEMA).coalesce(1).write.parquet(src)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = monitor.run_monitor(spark.readStream.schema(monitor.LOG_SCHEMA).parquet(src), {"initial_stage": 9, "lc_stage": 9}, patience_ms=500)
        q = stream.writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
        until = time.time() + 60
        while time.time() < until and spark.table("gaps").count() < 5:
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set(name, was)
    assert [r.step for r in spark.table("gaps").orderBy("step").collect()] == [1, 2, 4, 5, 6]


def test_source_offsets_are_range_numbers(spark, tmp_path):
    n = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    _, _, work = packer.run_stream_pack(spark, n, 1, 1000, 4, work=f"{tmp_path}/w")
    import glob

    offsets = [json.loads(open(p).read().splitlines()[-1])["next"] for p in sorted(glob.glob(f"{work}/checkpoint/offsets/[0-9]*"))]
    assert offsets == list(range(1, len(offsets) + 1)) and len(offsets) >= 4


class _State:
    """A run's state kept in memory, with the number of accesses."""

    def __init__(self):
        self.value, self.held, self.accesses = None, {}, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.held))

    def containsKey(self, key):  # noqa: N802
        self.accesses += 1
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.accesses += 1
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.accesses += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.accesses += 1
        del self.held[key]


def _monitored(frames, targets, calls=1):
    m, state = monitor.RunMonitor(targets, 0.1, None), _State()
    m.init(state)
    each = -(-len(frames) // calls)
    out = [o for i in range(0, len(frames), each) for o in m.handleInputRows(("a",), iter(frames[i:i + each]), None)]
    return m, state, pd.concat(out, ignore_index=True)


def test_waiting_rows_share_state_accesses():
    """Files that come in another order than they were written in: a state
    access moves a window of rows, not one."""
    n, size = 40_000, 5000
    log, targets = _log("a", n), {"initial_stage": 500, "lc_stage": 50_000}
    frames = [log.iloc[i:i + size] for i in range(0, n, size)]
    _, _, want = _monitored(frames, targets)
    _, state, got = _monitored(frames[::-1], targets, calls=4)
    assert not state.held and state.accesses < n // 20
    pd.testing.assert_frame_equal(got, want)


def test_waiting_rows_that_come_again(monkeypatch):
    monkeypatch.setattr(monitor, "WINDOW", 8)
    log, targets = _log("a", 60), {"initial_stage": 500, "lc_stage": 50_000}
    _, _, want = _monitored([log], targets)
    pick = lambda *steps: log[log.step.isin(steps)]
    frames = [pick(5, 9, 30), pick(5, 6, 31), log[log.step <= 7], log[log.step <= 20].sample(frac=1, random_state=1), log.sample(frac=1, random_state=2)]
    m, state, got = _monitored(frames, targets, calls=5)
    pd.testing.assert_frame_equal(got, want)
    assert not [o for o in m.handleExpiredTimer(("a",), None, None)] and not state.held  # nothing comes twice
