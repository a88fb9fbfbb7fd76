"""Tables that streams keep, and keyed state, against brute force: replays, restarts, late rows, timers."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldrecon.streaming import live, stateful
from fieldrecon.streaming.tables import BatchTable, all_rows, newest_by, tail_by


def numbers(spark, first, n, keys):
    return spark.range(first, first + n).select((F.col("id") % keys).alias("run_id"), F.col("id").alias("line_id"), F.lit("x").alias("line"))


def test_batches_add_only_their_own_rows_and_replays_change_nothing(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), numbers(spark, 0, 1, 1).schema, tail_by("run_id", "line_id", 3))
    table.add(numbers(spark, 0, 30_000, 5000), 0)
    for n in range(1, 4):
        table.add(numbers(spark, 30_000 + 10 * n, 10, 5000), n)
    written = table.bytes_added()
    assert all(written[n] < written[0] / 5 for n in (1, 2, 3))  # ten rows cost no more as the table grows
    once = sorted(map(tuple, table.read().collect()))
    for n in (2, 3):
        table.add(numbers(spark, 30_000 + 10 * n, 10, 5000), n)
    assert sorted(map(tuple, table.read().collect())) == once and len(once) == 15_000


def test_merges_keep_the_table_and_drop_old_folders(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k, n, f"v{n}-{k}") for k in range(n % 3, 9, 3)], "k long, t long, v string")
    table = BatchTable(spark, str(tmp_path / "t"), rows(0).schema, newest_by(["k"], ["t"]))
    expected = {}
    for n in range(20):
        table.add(rows(n), n)
        expected.update({k: (k, n, f"v{n}-{k}") for k in range(n % 3, 9, 3)})
        if n in (7, 19):
            table.add(rows(n), n)  # a replay right after a merge
    assert sorted(map(tuple, table.read().collect())) == sorted(expected.values())
    assert any(p.name.startswith("merged-") for p in (tmp_path / "t").iterdir()) and len(table.bytes_added()) < 20
    assert BatchTable(spark, str(tmp_path / "none"), rows(0).schema, all_rows).read().count() == 0


def test_one_reading_feeds_two_tables(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    branches = {"even": lambda b: b.filter("id % 2 = 0"), "odd": lambda b: b.filter("id % 2 = 1")}
    for k in range(3):
        if k < 2:
            spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(source)
        found = live.fork(live.read_stream(spark, source, spark.range(1).schema), branches, folder)
    assert sorted(r[0] for r in found["even"].collect()) == list(range(0, 20, 2))
    assert sorted(r[0] for r in found["odd"].collect()) == list(range(1, 20, 2))
    BatchTable(spark, folder + "/odd", spark.range(1).schema, all_rows).add(spark.range(11, 20, 2), 1)  # batch 1 again
    assert live.fork(live.read_stream(spark, source, spark.range(1).schema), branches, folder)["odd"].count() == 10


class Handle:
    """State of one key, outside Spark."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def expire(self, processor, watermark):
        out = []
        for t in sorted(t for t in self.timers if t <= watermark):
            self.timers.remove(t)
            out += list(processor.handleExpiredTimer((1, "step1"), None, None))
        return out


def status_of(events, watermark, timeout):
    """(status, events, timeouts) of events (ms, id, kind) of one step."""
    events = sorted(events)
    status, timeouts = "waiting", 0
    for (ms, _, kind), later in zip(events, [*events[1:], (watermark, 0, "")], strict=True):
        status = {"end": "done", "fail": "error"}.get(kind, "active")
        if status == "active" and later[0] - ms >= timeout:
            timeouts, status = timeouts + 1, "error"
    return status, len(events), timeouts


@pytest.mark.parametrize("files", [1, 2, 5])
def test_step_status_equals_a_fold_over_all_events(files):
    rng = random.Random(files)
    timeout = 30 * 60_000
    for _ in range(150):
        at = sorted(rng.sample(range(20 * timeout // 60_000), rng.randint(1, 25)))
        events = [(60_000 * t, i, rng.choice(["progress"] * 4 + ["end", "fail"])) for i, t in enumerate(at)]
        handle, processor, last = Handle(), stateful.StepStatus(timeout), None
        processor.init(handle)
        cuts = sorted(rng.sample(range(len(events) + 1), min(files - 1, len(events))))
        for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True):
            part = events[a:b]
            if not part:
                continue
            rng.shuffle(part)
            rows = pd.DataFrame([(i, pd.Timestamp(ms, unit="ms"), 1, "step1", kind) for ms, i, kind in part], columns=["event_id", "ts", "run_id", "step", "kind"])
            halves = [rows.iloc[: len(rows) // 2], rows.iloc[len(rows) // 2 :]]  # two tasks reduce their halves
            spans = [s for h in halves if len(h) for s in stateful._spans(timeout // stateful.SLOTS)(iter([h]))]
            out = list(processor.handleInputRows((1, "step1"), iter(spans), None)) + handle.expire(processor, events[b - 1][0])
            last = out[-1].iloc[0]
        later = handle.expire(processor, at[-1] * 60_000 + timeout)
        last = later[-1].iloc[0] if later else last
        assert (last["status"], last["n_events"], last["n_timeouts"]) == status_of(events, at[-1] * 60_000 + timeout, timeout)


def test_late_event_counts_but_changes_no_status():
    handle, processor = Handle(), stateful.StepStatus()
    processor.init(handle)
    spans = lambda ms, kind: pd.DataFrame([(1, "step1", pd.Timestamp(ms, unit="ms"), pd.Timestamp(ms, unit="ms"), ms, kind, 1)],
                                          columns=["run_id", "step", "first_ts", "last_ts", "last_id", "last_kind", "n"])
    list(processor.handleInputRows((1, "step1"), iter([spans(9_000, "end")]), None))
    row = list(processor.handleInputRows((1, "step1"), iter([spans(5_000, "fail")]), None))[0].iloc[0]
    assert (row["status"], row["n_events"]) == ("done", 2) and not handle.timers


def test_newer_run_resets_counts_and_silence_forgets_them():
    handle, processor = Handle(), stateful.RunCounter(keep_ms=1000)
    processor.init(handle)
    part = lambda *rows: iter([pd.DataFrame([(s, r, n, pd.Timestamp(t, unit="ms")) for s, r, n, t in rows], columns=["stage", "run_id", "n", "ts"])])
    feed = lambda *rows: tuple(list(processor.handleInputRows(("a",), part(*rows), None))[0].iloc[0][["run_id", "n"]])
    assert feed(("a", 1, 3, 10), ("a", 1, 2, 20)) == (1, 5)
    assert feed(("a", 2, 1, 30), ("a", 1, 9, 25)) == (2, 1)  # the newer run starts afresh
    assert feed(("a", 1, 4, 40)) == (2, 1)  # an old run's rows come too late
    assert not handle.expire(processor, 1029)
    assert handle.expire(processor, 1030)[0].iloc[0]["n"] == 0 and not handle.exists()


def test_status_stream_survives_a_restart(spark, tmp_path):
    """Real stream: two files with a start after each and one more give what one file gives."""
    rng = random.Random(7)
    rows = [(i, 86_400_000 + 60_000 * rng.randrange(900), 1 + i % 2, f"step{1 + i % 3}", rng.choice(["progress"] * 5 + ["end", "fail"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, ms long, run_id long, step string, kind string")
    frame = frame.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "run_id", "step", "kind")
    session = live.stream_session(spark)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for cut in ("ts < timestamp_ntz'1970-01-02 07:00:00'", "ts >= timestamp_ntz'1970-01-02 07:00:00'", None):
        if cut:
            frame.filter(cut).coalesce(2).write.mode("append").parquet(source)
        stream = live.read_stream(session, source, frame.schema)
        got = live.change_table(stateful.step_changes(stream), ["run_id", "step"], folder, spark)
    newest = max(r[1] for r in rows) - 600_000
    expected = set()
    for run, step in {(r[2], r[3]) for r in rows}:
        expected.add((run, step, *status_of([(r[1], r[0], r[4]) for r in rows if r[2:4] == (run, step)], newest, stateful.TIMEOUT_MS)))
    assert set(map(tuple, got.collect())) == expected
