"""Run monitor over a log stream (X3): loss average, seconds per update, rate and
ETA per update, with state carried per run.

``transformWithState`` keyed by run. The typed state of a run is the next step
and what the averages and the stage clock need; rows come frame by frame, so a
task holds one frame of a run, however much of it a micro-batch brings. Rows
that arrive before their step's turn wait in a map state on disk, a window of
``WINDOW`` steps to an entry, so that a state access moves hundreds of them, and
follow as soon as the gap is closed. A live monitor has ``patience_ms``: if a gap stays
open for so long, a timer gives what waits, in order, without the missing
steps. Such a stream runs on, as its timers may fire at any time; without
patience a stream over what is there (``availableNow``) ends by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: columns of the log: step counts up from 1 in a run, seconds is the row's time
LOG_SCHEMA = "run string, step long, seconds double, loss double, stage string, stage_step long, stage_tokens long"
OUT_SCHEMA = "run string, step long, ema double, avg_time double, elapsed_sec double, rate double, eta_sec long"
_STATE = "next long, ema double, avg_time double, last double, stage string, stage_start double"
_ROWS = pa.schema([("step", pa.int64()), ("seconds", pa.float64()), ("loss", pa.float64()), ("stage", pa.string()),
                   ("stage_step", pa.int64()), ("stage_tokens", pa.int64())])
#: steps whose waiting rows share an entry of the state, and waiting rows that follow at once
WINDOW, LOT = 1 << 10, 1000


def averaged(values: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
    """``e = alpha v + (1 - alpha) e`` behind ``before``; the first value without one."""
    s = pd.Series(values if before is None else np.append(before, values))
    return s.ewm(alpha=alpha, adjust=False).mean().to_numpy()[0 if before is None else 1:]


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    batch = pa.RecordBatch.from_pandas(rows, _ROWS, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _unpacked(value: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value[0])).read_pandas()


def _in_turn(steps: np.ndarray, step: int) -> int:
    """How many of the sorted ``steps`` follow from ``step`` on without a gap."""
    ready = steps == step + np.arange(len(steps))
    return len(steps) if ready.all() else int(ready.argmin())


class RunMonitor(StatefulProcessor):
    """``targets``: steps of the initial stage, tokens of the later ones."""

    def __init__(self, targets: dict[str, int], alpha: float, patience_ms: int | None) -> None:
        self.targets, self.alpha, self.patience_ms = targets, alpha, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)
        self.waiting = handle.getMapState("waiting", "window long", "rows binary")

    def _follow(self, run: str, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """The status of rows in step order behind ``state``, and the state after them."""
        _, ema, avg, last, stage, start = state if state is not None else (1, None, None, None, None, None)
        at, stages = rows["seconds"].to_numpy(float), rows["stage"].to_numpy()
        first_of_run = last is None
        gaps = np.diff(at, prepend=at[0] if first_of_run else last)
        loss, times = averaged(rows["loss"].to_numpy(float), ema, self.alpha), averaged(gaps, avg, self.alpha)
        new = np.flatnonzero(np.append(stages[0] != stage, stages[1:] != stages[:-1]))
        begin = np.full(len(at), np.nan if start is None else start)
        for i, k in enumerate(new):  # a few stages a run
            begin[k:new[i + 1] if i + 1 < len(new) else len(at)] = at[k]
        elapsed = at - begin
        initial = stages == "initial_stage"
        done = np.where(initial, rows["stage_step"].to_numpy(float), rows["stage_tokens"].to_numpy(float))
        goal = np.array([self.targets[s] for s in stages], float)
        runs = (done > 0) & (elapsed > 0)
        rate = np.divide(done, elapsed, out=np.full(len(at), np.nan), where=elapsed > 0)
        eta = np.floor(np.maximum(np.divide(goal - done, rate, out=np.zeros(len(at)), where=runs), 0.0))
        out = pd.DataFrame({"run": run, "step": rows["step"].to_numpy(), "ema": loss, "avg_time": times, "elapsed_sec": elapsed,
                            "rate": pd.Series(rate).where(elapsed > 0, None).astype(object), "eta_sec": eta.astype(np.int64)})
        return out, (int(rows["step"].iloc[-1]) + 1, float(loss[-1]), float(times[-1]), float(at[-1]), str(stages[-1]), float(begin[-1]))

    def _hold(self, rows: pd.DataFrame) -> None:
        """Puts rows by; one that came again takes the place of the older one."""
        for window, new in rows.groupby(rows["step"].to_numpy() // WINDOW):
            key = (int(window),)
            if self.waiting.containsKey(key):
                new = pd.concat([_unpacked(self.waiting.getValue(key)), new[_ROWS.names]])
                new = new.drop_duplicates("step", keep="last").sort_values("step")
            self.waiting.updateValue(key, _packed(new))

    def _released(self, step: int) -> pd.DataFrame:
        """The waiting rows from ``step`` on, as far as there is no gap, ``LOT`` at most."""
        lot, end = [_ROWS.empty_table().to_pandas()], step + LOT
        while step < end and self.waiting.containsKey(key := (step // WINDOW,)):
            rows = _unpacked(self.waiting.getValue(key))
            rest = rows[rows["step"] >= step]  # those before it came again meanwhile
            n = min(_in_turn(rest["step"].to_numpy(), step), end - step)
            if n == len(rest):
                self.waiting.removeKey(key)
            elif n or len(rest) < len(rows):
                self.waiting.updateValue(key, _packed(rest.iloc[n:]))
            if n == 0:
                break
            lot.append(rest.iloc[:n])
            step += n
        return pd.concat(lot[1:]) if len(lot) > 1 else lot[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else None
        held = False
        for frame in rows:
            frame = frame.sort_values("step", kind="stable")
            step = state[0] if state is not None else 1
            frame = frame[frame["step"] >= step].drop_duplicates("step")  # a row that came again
            n = _in_turn(frame["step"].to_numpy(), step)
            if n < len(frame):
                self._hold(frame.iloc[n:])
                held = True
            now = frame.iloc[:n]
            while len(now):
                out, state = self._follow(key[0], now, state)
                yield out
                now = self._released(state[0])
        if state is not None:
            self.state.update(state)
        if held and self.patience_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else None
        for window in sorted(k[0] for k in self.waiting.keys()):
            while self.waiting.containsKey((window,)):
                rows = _unpacked(self.waiting.getValue((window,)))
                rows = rows[rows["step"] >= (state[0] if state is not None else 1)]
                if not len(rows):
                    self.waiting.removeKey((window,))
                    break
                out, state = self._follow(key[0], self._released(int(rows["step"].iloc[0])), state)
                yield out
        if state is not None:
            self.state.update(state)

    def close(self) -> None:
        pass


def run_monitor(log_stream: DataFrame, targets: dict[str, int], alpha: float = 0.1, patience_ms: int | None = None) -> DataFrame:
    """The status of every update of a streamed log (columns of ``LOG_SCHEMA``;
    further ones are dropped), in append mode. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    names = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
    return log_stream.select(*names).groupBy("run").transformWithStateInPandas(
        RunMonitor(targets, alpha, patience_ms), OUT_SCHEMA, "append", "None" if patience_ms is None else "ProcessingTime")
