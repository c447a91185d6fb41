"""The streaming monitor emits exactly the batch monitor's events, whatever the order of arrival."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainscope.operators import history as H
from chainscope.sources.fixtures import Workspace
from chainscope.streaming import monitor as M
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["project_id", "severity", "findings", "files", "total_files", "risk_score"]


def test_stream_equals_batch(spark):
    ws = Workspace.of(spark, SF_SMALL)
    obs, man = ws.table("observations"), ws.table("manifest")
    files = ws.table("watched_files")
    batch = _rows(H.monitor_check(obs, man, files=files).select(*H.EVENT_COLS))
    assert _rows(M.monitor_stream(spark, obs, man, files=files)) == batch and any("package.json" in r for r in batch)


def test_stream_with_init_equals_batch(spark):
    ws = Workspace.of(spark, SF_SMALL)
    obs, man = ws.table("observations"), ws.table("manifest")
    init = H.init_state(obs)
    rest = obs.join(init.select("project_id", F.col("day").alias("_d")).distinct(), "project_id") \
        .where(F.col("day") > F.col("_d")).drop("_d")
    batch = _rows(H.monitor_check(rest, man, initial=init).select(*H.EVENT_COLS))
    assert _rows(M.monitor_stream(spark, rest, man, initial=init)) == batch and len(batch) > 0


@pytest.fixture(scope="module")
def observed(spark):
    """Three projects of different rhythm, one package in most checks, versions and scores that move."""
    rng, rows = random.Random(4), []
    for project, step in (("busy", 1), ("slow", 3), ("once", 30)):
        for d in range(0, 12, step):
            day = datetime.datetime(2024, 3, 1) + datetime.timedelta(days=d)
            for k in range(9):
                if rng.random() < 0.7:
                    rows.append((project, f"pkg-{k}", day + datetime.timedelta(minutes=rng.randrange(1440)), day.date(), f"1.{rng.randrange(2)}", float(rng.randrange(11))))
    man = spark.createDataFrame([("busy", "pkg-1"), ("busy", "pkg-1"), ("slow", "pkg-2")], "project_id string, name string")
    return rows, man


def _land(spark, source, rows):
    spark.createDataFrame(rows, M.OBS_SCHEMA).coalesce(1).write.mode("append").parquet(source)


def test_late_repeated_and_out_of_order_rows(spark, observed, tmp_path):
    rows, man = observed
    rng = random.Random(9)
    # arrival: up to three days late, in any order, one row in three twice
    arrivals = [(r[2] + datetime.timedelta(days=3 * rng.random()), r) for r in rows]
    arrivals += [(t + datetime.timedelta(days=rng.random()), r) for t, r in arrivals if rng.random() < 0.33]
    arrivals.sort(key=lambda x: x[0])
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    cut = [arrivals[k::1][:20] for k in range(0, len(arrivals), 20)]
    for part in cut[:len(cut) // 2]:
        _land(spark, source, [r for _, r in rng.sample(part, len(part))])
    events = M.run_monitor_stream(spark, source, man, work, files_per_trigger=1, delay="4 days")
    first = _rows(spark.read.parquet(events).select(*H.EVENT_COLS))
    want = _rows(H.monitor_check(spark.createDataFrame(rows, M.OBS_SCHEMA), man).select(*H.EVENT_COLS))
    assert set(first) < set(want)  # complete checks only, and none of them twice
    assert len(first) == len(set(first))
    for part in cut[len(cut) // 2:]:
        _land(spark, source, [r for _, r in rng.sample(part, len(part))])
    M.end_input(spark, source, spark.createDataFrame(rows, M.OBS_SCHEMA), delay="4 days")
    # the job starts again from its state store
    M.run_monitor_stream(spark, source, man, work, files_per_trigger=2, delay="4 days")
    assert _rows(spark.read.parquet(events).select(*H.EVENT_COLS)) == want


def test_appends_of_more_files_than_a_batch_reads(spark, observed):
    """A row counts whichever file of its append it is in: none is late."""
    rows, man = observed
    obs = spark.createDataFrame(rows, M.OBS_SCHEMA).repartition(20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # each file is a task, which writes a file of each append
    try:
        got = _rows(M.monitor_stream(spark, obs, man))
        windows = _rows(M.posture_stream(spark, obs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == _rows(H.monitor_check(obs, man).select(*H.EVENT_COLS)) and got
    assert windows == _rows(H.posture_windows(obs).select("project_id", "window_start", "observations", "max_risk", "high_risk"))


def test_complete_days_are_read_from_the_state_once():
    """Rows read from the state by a batch that completes 30 days: each once, and as blocks."""
    class State(list):
        read = 0

        def get(self):
            State.read += len(self)
            return iter(list(self))

        def put(self, rows):
            self[:] = rows
        appendList, appendValue, clear = list.extend, list.append, list.clear

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        timers: list = []

        def getListState(self, name, schema):
            return State()

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Time:
        def getExpiryTimeInMs(self):
            return self.at

        def getCurrentWatermarkInMs(self):
            return 30

    monitor, time, events = M.Monitor(7.0), Time(), []
    monitor.init(Handle())
    rows = [(f"2024-03-{d:02d}", d, f"pkg-{k}", f"1.{d % 2}", 1.0, True) for d in range(1, 31) for k in range(200)]
    monitor.handleInputRows(("p", 0), iter([pd.DataFrame(rows, columns=["day", "day_end", "name", "version", "score", "listed"])]), time)
    State.read = 0
    for time.at in sorted(Handle.timers):
        events += [tuple(e) for part in monitor.handleExpiredTimer(("p", 0), time, time) for e in part.itertuples(index=False)]
    assert State.read < 200
    assert [sum(e[2] == t for e in events) for t in ("package-added", "package-updated", "lockfile-changed")] == [200, 29 * 200, 29]
    assert not monitor.waiting and not monitor.days and monitor.last.held == ("2024-03-30",)


def test_rows_beyond_the_watermark_change_nothing(spark, observed, tmp_path):
    rows, man = observed
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    _land(spark, source, rows)
    all_rows = spark.createDataFrame(rows, M.OBS_SCHEMA)
    M.end_input(spark, source, all_rows)
    events = M.run_monitor_stream(spark, source, man, work)
    told = _rows(spark.read.parquet(events))
    _land(spark, source, [("busy", "pkg-new", rows[0][2], rows[0][3], "9", 10.0)])
    M.run_monitor_stream(spark, source, man, work)
    assert _rows(spark.read.parquet(events)) == told and told


def test_clear_events_keeps_the_state(spark, observed, tmp_path):
    rows, man = observed
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    early = [r for r in rows if r[3] < datetime.date(2024, 3, 7)]
    _land(spark, source, early)
    _land(spark, source, [r for r in rows if r[3] == datetime.date(2024, 3, 9)])
    events = M.run_monitor_stream(spark, source, man, work, files_per_trigger=1)
    assert spark.read.parquet(events).count() > 0
    M.clear_events(spark, work)
    _land(spark, source, [r for r in rows if r[3] > datetime.date(2024, 3, 9)])
    M.end_input(spark, source, spark.createDataFrame(rows, M.OBS_SCHEMA))
    M.run_monitor_stream(spark, source, man, work)
    kept = [r for r in rows if r[3] < datetime.date(2024, 3, 7) or r[3] >= datetime.date(2024, 3, 9)]
    want = H.monitor_check(spark.createDataFrame(kept, M.OBS_SCHEMA), man).select(*H.EVENT_COLS)
    got = spark.read.parquet(events).select(*H.EVENT_COLS)
    first = got.agg(F.min("check_day")).first()[0]
    assert first > datetime.date(2024, 3, 6)
    assert _rows(got) == _rows(want.where(F.col("check_day") >= F.lit(first)))


def test_windows_on_a_stream_equal_the_batch(spark, observed, tmp_path):
    rows, _ = observed
    rng = random.Random(2)
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    ordered = sorted(rows, key=lambda r: r[2])
    for k in range(0, len(ordered), 25):
        _land(spark, source, rng.sample(ordered[k:k + 25], len(ordered[k:k + 25])) + ordered[max(0, k - 5):k])  # some come twice
    M.end_input(spark, source, spark.createDataFrame(rows, M.OBS_SCHEMA))
    out = M.run_posture_stream(spark, source, work, files_per_trigger=1)
    cols = ["project_id", "window_start", "observations", "max_risk", "high_risk"]
    assert _rows(spark.read.parquet(out).select(*cols)) == _rows(H.posture_windows(spark.createDataFrame(rows, M.OBS_SCHEMA)).select(*cols))


def test_streams_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], M.OBS_SCHEMA)
    M.replay_source(none, str(tmp_path / "in"))
    none.write.mode("append").parquet(str(tmp_path / "in"))
    man = spark.createDataFrame([], "project_id string, name string")
    events = M.run_monitor_stream(spark, str(tmp_path / "in"), man, str(tmp_path / "work"))
    assert events.endswith("/events")
