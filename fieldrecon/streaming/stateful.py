"""Operators over streams with state of their own: step status with timers, counters that a newer run resets.

Rows of one key may be many, so each task first reduces its part of a batch to
a few rows per key; only those reach the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: milliseconds after which an active step without events counts as failed, and how late events may be
TIMEOUT_MS = 30 * 60_000
LATE = "10 minutes"
#: parts of a timeout within which a task reduces a step's events to one row
SLOTS = 3

STATUS = "run_id long, step string, status string, n_events long, n_timeouts long, version long"
_SPAN = "run_id long, step string, first_ts timestamp, last_ts timestamp, last_id long, last_kind string, n long"
_FIRST, _LAST = ["first_ts"], ["last_ts", "last_id"]


def _spans(slot_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per (run, step, slot) of a batch: first and last event and their number.  A slot is too short for a timeout."""
        for rows in batches:
            slot = rows["ts"].astype("int64") // (slot_ms * 1_000_000)
            groups = rows.sort_values(["ts", "event_id"]).groupby(["run_id", "step", slot.rename("slot")], sort=False)
            out = groups.agg(first_ts=("ts", "first"), last_ts=("ts", "last"), last_id=("event_id", "last"), last_kind=("kind", "last"), n=("kind", "size"))
            yield out.reset_index().drop(columns="slot")

    return run


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


class StepStatus(StatefulProcessor):
    """waiting -> active -> done / error of one (run, step); an active step is an error once nothing comes for `timeout_ms`.

    Events are taken in the order of their time; of a batch, those older than
    the newest one already seen are counted but change no status.
    """

    def __init__(self, timeout_ms: int = TIMEOUT_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("step", "status string, kind string, last_ts timestamp, last_id long, n_events long, n_timeouts long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = pd.concat(list(rows)).sort_values(["first_ts", "last_ts", "last_id"])
        status, kind, last, last_id, n, timeouts, version = self.state.get() if self.state.exists() else ("waiting", None, None, -1, 0, 0, 0)
        last = None if last is None else pd.Timestamp(last)
        for r in spans.itertuples():
            n += int(r.n)
            if last is not None and status == "active" and _ms(r.first_ts) - _ms(last) >= self.timeout_ms:
                timeouts += 1  # its timer would have run out first
            if last is None or (r.last_ts, int(r.last_id)) > (last, last_id):
                last, last_id, kind = r.last_ts, int(r.last_id), r.last_kind
                status = {"end": "done", "fail": "error"}.get(kind, "active")
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if status == "active":
            self.handle.registerTimer(_ms(last) + self.timeout_ms)
        yield self._keep(key, status, kind, last, last_id, n, timeouts, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, kind, last, last_id, n, timeouts, version = self.state.get()
        if status == "active":
            yield self._keep(key, "error", kind, pd.Timestamp(last), last_id, n, timeouts + 1, version)

    def _keep(self, key, status, kind, last, last_id, n, timeouts, version) -> pd.DataFrame:
        self.state.update((status, kind, last.to_pydatetime(), last_id, n, timeouts, version + 1))
        return pd.DataFrame({"run_id": [key[0]], "step": [key[1]], "status": [status], "n_events": [n], "n_timeouts": [timeouts], "version": [version + 1]})

    def close(self) -> None:
        pass


def step_changes(stream: DataFrame, timeout_ms: int = TIMEOUT_MS, late: str = LATE) -> DataFrame:
    """Every change of a step's status; `version` numbers those of one step.

    `stream`: event_id, ts, run_id, step, kind (progress, end or fail).
    """
    rows = stream.select("event_id", "ts", "run_id", "step", "kind").mapInPandas(_spans(timeout_ms // SLOTS), _SPAN)
    spans = rows.withWatermark("last_ts", late).groupBy("run_id", "step")
    return spans.transformWithStateInPandas(StepStatus(timeout_ms), STATUS, "Update", "EventTime")


COUNTS = "stage string, run_id long, n long, version long"
#: event time after which a stage that no longer occurs is forgotten
KEEP_MS = 30 * 86_400_000


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each stage per run, and the time of the last; of a part of a batch."""
    for rows in batches:
        yield rows.groupby(["stage", "run_id"], dropna=False).agg(n=("ts", "size"), ts=("ts", "max")).reset_index()


class RunCounter(StatefulProcessor):
    """Count of one stage in the newest run: a newer run starts it afresh, an older run's rows are ignored.

    State lives until `keep_ms` of event time pass without a row of the stage; a
    count of 0 then tells readers that it is gone.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "run_id long, n long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).groupby("run_id").agg(n=("n", "sum"), ts=("ts", "max"))
        run, n, version = self.state.get() if self.state.exists() else (-1, 0, 0)
        newest = int(part.index.max())
        if newest > run:
            run, n = newest, 0
        if run in part.index:
            n += int(part.loc[run, "n"])
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(_ms(part.loc[run, "ts"]) + self.keep_ms)
        self.state.update((run, n, version + 1))
        yield self._row(key, run, n, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, _, version = self.state.get()
        self.state.clear()
        yield self._row(key, run, 0, version + 1)

    def _row(self, key, run: int, n: int, version: int) -> pd.DataFrame:
        return pd.DataFrame({"stage": [key[0]], "run_id": [run], "n": [n], "version": [version]})

    def close(self) -> None:
        pass


def current_run_changes(stream: DataFrame, keep_ms: int = KEEP_MS, late: str = LATE) -> DataFrame:
    """Changes of the count of each stage in the newest run; `stream`: ts, run_id, stage."""
    rows = stream.select("ts", "stage", "run_id").mapInPandas(_partial_counts, "stage string, run_id long, n long, ts timestamp")
    rows = rows.withWatermark("ts", late).groupBy("stage")
    return rows.transformWithStateInPandas(RunCounter(keep_ms), COUNTS, "Update", "EventTime")
