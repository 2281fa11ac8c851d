"""Differential tests: each distributed operator against a literal Python
emulation of the reference's loop, on random inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from pressline.operators import ordered as O
from pressline.operators import packing as K
from pressline.operators import runlog as M


def split_loop(lengths, V, T):
    """The reference's streaming split loop, literally."""
    val = train = 0
    out = []
    done = False
    for n in lengths:
        if done:
            out.append((0, 0))
            continue
        if val < V:
            need = V - val
            if n >= need:
                val += need
                out.append((need, 0))
                continue
            val += n
            out.append((n, 0))
        else:
            need = T - train
            if n >= need:
                train += need
                out.append((0, need))
                done = True
            else:
                train += n
                out.append((0, n))
    return out


def test_split_matches_loop(spark):
    rnd = random.Random(3)
    rows, cfg, expect = [], [], {}
    for case in range(60):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 30))]
        V, T = rnd.randint(0, 300), rnd.randint(0, 500)
        st = f"c{case}"
        rows += [(st, i, n) for i, n in enumerate(lengths)]
        cfg.append((st, V, T))
        for i, r in enumerate(split_loop(lengths, V, T)):
            expect[(st, i)] = r
    docs = spark.createDataFrame(rows, "stage string, doc_id long, n long")
    budgets = spark.createDataFrame(cfg, "stage string, val_target long, train_target long")
    got = K.split_by_budget(K.token_offsets(docs, by=["stage"]), budgets).collect()
    assert {(r["stage"], r["doc_id"]): (r["val_take"], r["train_take"]) for r in got} == expect


def test_blocks_match_slicing(spark):
    rnd = random.Random(5)
    for _ in range(6):
        L = rnd.randint(2, 9)
        lens = [rnd.randint(1, 15) for _ in range(rnd.randint(1, 12))]
        stream, pieces, s = [], [], 0
        for i, n in enumerate(lens):
            ids = [rnd.randint(3, 300) for _ in range(n)]
            pieces.append(("s", "train", s, n, ids))
            stream += ids
            s += n
        p = spark.createDataFrame(pieces, "stage string, split string, pstart long, take long, ids array<int>")
        total = (len(stream) - 1) // L
        got = {r["block_idx"]: r["tokens"] for r in K.make_blocks(p, L, with_xy=False).collect()}
        want = {b: stream[b * L: b * L + L + 1] for b in range(total)}
        assert got == want


def _running(rows):
    exp, acc = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        exp[(g, k)] = acc.get(g, 0)
        acc[g] = exp[(g, k)] + v
    return exp


def test_prefix_sums_of_any_key(spark):
    """Dense, sparse, hashed and string keys, null groups, a hot group."""
    import hashlib

    rnd = random.Random(11)
    names = ["hot"] * 6 + ["a", "b", None]
    for key in (lambda i: i, lambda i: i * 10**12, lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) - 2**59,
                lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        rows = [(rnd.choice(names), key(i), rnd.randint(0, 9)) for i in range(1500)]
        kind = "string" if isinstance(rows[0][1], str) else "long"
        df = spark.createDataFrame(rows, f"g string, k {kind}, v long")
        got = O.prefix_sums(df, "k", {"s": F.col("v")}, by=["g"], bucket_rows=64).collect()
        assert {(r["g"], r["k"]): r["s"] for r in got} == _running(rows)
        # no range holds over a few times its rows, none is far too small on average
        sizes = [r["count"] for r in df.groupBy(O.range_bucket(df, "k", ["g"], 64).alias("b")).count().collect()]
        assert max(sizes) <= 4 * 64 and len(sizes) >= 1500 / 64 / 2
    assert O.prefix_sums(df.limit(0), "k", {"s": F.col("v")}, bucket_rows=4).count() == 0


def test_ema_matches_recursion(spark):
    rnd = random.Random(2)
    vals = [rnd.uniform(0, 10) for _ in range(3000)]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(vals)], "run string, step long, loss double")
    for B, alpha, group in ((7, 0.1, 4), (100, 0.1, 512), (None, 0.1, 512), (3, 0.001, 5), (1, 0.9, 8)):
        got = [r["ema"] for r in O.ema(df, ["run"], "step", "loss", "ema", alpha, bucket_rows=B, group=group).orderBy("step").collect()]
        e, exp = None, []
        for v in vals:
            e = v if e is None else alpha * v + (1 - alpha) * e
            exp.append(e)
        assert np.allclose(got, exp, rtol=1e-12, atol=1e-12)


def test_moving_average_matches_convolve(spark):
    rnd = random.Random(4)
    for n in (1, 5, 37, 250):
        vals = [rnd.uniform(0, 5) for _ in range(n)]
        df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(vals)], "run string, step long, loss double")
        got = M.moving_average(df).orderBy("step").collect()
        w = min(100, max(2, n // 10))
        if n <= 1 or n < w:
            assert got == []
            continue
        sm = np.convolve(vals, np.ones(w) / w, mode="valid")
        off = (w - 1) // 2
        assert [r["step"] for r in got] == list(range(1 + off, 1 + off + len(sm)))
        assert np.allclose([r["smoothed"] for r in got], sm)


def test_moving_average_of_many_runs_in_one_plan(spark):
    """Runs of different window sizes; NaN, infinite and null values stay in their frames."""
    rnd, rows = random.Random(9), []
    runs = {"a": 12, "b": 30, None: 55, "c": 400, "d": 1}
    for run, n in runs.items():
        rows += [(run, i + 1, rnd.uniform(-5, 5)) for i in range(n)]
    odd = {("c", 100): float("nan"), ("c", 200): float("inf"), ("c", 210): float("-inf"), ("b", 3): None, ("c", 300): 1e15}
    rows = [(r, s, odd.get((r, s), v)) for r, s, v in rows]
    got = {(r["run"], r["step"]): r["smoothed"] for r in M.moving_average(spark.createDataFrame(rows, "run string, step long, loss double")).collect()}
    for run, n in runs.items():
        vals = [v for r, _, v in rows if r == run]
        w = min(100, max(2, n // 10))
        off = (w - 1) // 2
        for c in range(n):
            frame = vals[c - off:c - off + w] if c >= off and c - off + w <= n and n > 1 and n >= w else [None]
            if None in frame:
                assert (run, c + 1) not in got
            else:
                assert np.isclose(got.pop((run, c + 1)), sum(frame) / w, rtol=1e-9, atol=1, equal_nan=True) if 1e15 in vals[:c + w] else \
                    np.isclose(got.pop((run, c + 1)), sum(frame) / w, equal_nan=True)
    assert not got


def test_halo_lag_across_buckets(spark):
    df = spark.range(1, 200).select(F.lit("r").alias("run"), F.col("id").alias("step"))
    got = O.lag_by_step(df, ["run"], "step", {"prev": "step"}, bucket_rows=8).orderBy("step").collect()
    assert [r["prev"] for r in got] == [None] + list(range(1, 199))


def test_accumulate_matches_loop(spark):
    from pressline.operators.schedule import accumulate

    rnd = random.Random(9)
    rows = []
    step = 0
    plan = [("initial_stage", 128, 2), ("initial_stage", 256, 3), ("lc_stage", 512, 2), ("lc_stage", 600, 4),
            ("annealing_stage", 600, 4)]
    for stage, L, A in plan:
        for _ in range(rnd.randint(1, 11)):
            step += 1
            rows.append(("r", step, stage, L, 1024, A, float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, "run string, step long, stage string, seq_len int, global_tokens long, A int, loss double")
    got = [(r["last_step"], round(r["loss"], 9)) for r in accumulate(df).orderBy("update").collect()]
    # literal loop: counter resets at shape change, running loss carries; flush at stage end
    exp, running, micro, prev_shape = [], 0.0, 0, None
    for i, (_, st, stage, L, G, A, loss) in enumerate(rows):
        if prev_shape is not None and prev_shape[0] != stage:
            if micro % prev_shape[2] != 0:
                exp.append((rows[i - 1][1], round(running * prev_shape[2] / (micro % prev_shape[2]), 9)))
            running, micro = 0.0, 0
        elif prev_shape is not None and prev_shape[1] != L:
            micro = 0
        prev_shape = (stage, L, A)
        running += loss / A
        micro += 1
        if micro % A == 0:
            exp.append((st, round(running, 9)))
            running = 0.0
    if micro % prev_shape[2] != 0:
        exp.append((rows[-1][1], round(running * prev_shape[2] / (micro % prev_shape[2]), 9)))
    assert got == exp
