"""Live monitor over a stream of package observations.

The monitor is a keyed state machine in Spark's state store
(``transformWithState``).  Observations are keyed by project and a part of its
packages (a hash of the name), so a project that sends a third of all rows is
spread over ``PARTS`` keys.  A key's state holds the packages of the last check,
the rows of checks that are not complete and their days; nothing else is kept,
and a package that is gone leaves the state.  Packages and rows are kept in
blocks: a call to the store costs about as much for a block as for a row.

A check is a project's day.  It is complete when the watermark has passed the
end of the day, which an event-time timer of the key tells; until then rows may
come late, out of order or twice.  That a project was checked on a day concerns
all its keys, also those without a row of that day (their packages were
removed): the first row of each (project, day) is sent on to all of them.

Micro-batches write their events to a folder of their own, which a retry
overwrites, and the state store has a version for each batch, so a lost
executor or driver costs one micro-batch.  Rows later than the watermark allows
are dropped, as in every Spark aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from chainscope.operators import history as H
from chainscope.session import shared_dir

OBS_SCHEMA = "project_id string, name string, ts timestamp_ntz, day date, version string, score double"
COLS = [c.split()[0] for c in OBS_SCHEMA.split(", ")]
FILES_SCHEMA = "project_id string, file string, ts timestamp_ntz, day date, hash string"
FILE_COLS = [c.split()[0] for c in FILES_SCHEMA.split(", ")]
#: Keys that a project's packages are dealt to.
PARTS = 16
#: Days of an append of ``replay_source``.  Its files may be read in any order, so
#: a row can come as much later than the others.
APPEND_DAYS = 5
#: Most rows in a block of the state.
BLOCK = 10_000
#: Before the names of watched files, which have a key of their own in each project.
_FILE = "\0"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENTS = "project_id string, check_day string, type string, severity string, package string, message string"


_PACKAGE = pa.schema([("name", pa.string()), ("version", pa.string()), ("score", pa.float64())])
_ROW = _PACKAGE.append(pa.field("listed", pa.bool_()))


def _put(state, rows: list[tuple]) -> None:
    """Replaces a list state; an empty list is no state."""
    state.put(rows) if rows else state.clear()


def _pack(rows: list[tuple], schema: pa.Schema) -> list[bytes]:
    """Rows as blocks, each an Arrow stream."""
    blocks = []
    for k in range(0, len(rows), BLOCK):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[k:k + BLOCK]), schema)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch(columns, schema=schema))
        blocks.append(sink.getvalue().to_pybytes())
    return blocks


def _unpack(block: bytes) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(pa.py_buffer(bytes(block))).read_all().columns))


class Monitor(StatefulProcessor):
    """Events of one key (project, part of its packages) as its checks complete.

    Input rows: day (ISO text), day_end (ms), name (null: the project was checked
    that day), version, score, listed (has a manifest entry).
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.packages = handle.getListState("packages", "block binary")
        self.waiting = handle.getListState("waiting", "day string, block binary")
        self.days = handle.getListState("days", "day string, day_end long")
        self.last = handle.getValueState("last", "day string")

    def _last(self) -> str:
        return self.last.get()[0] if self.last.exists() else ""

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The rows of an init step: known packages, for which there are no events."""
        rows = [(r.name, r.version, r.score) for r in initialState.itertuples(index=False, name="R") if isinstance(r.name, str)]
        _put(self.packages, [(b,) for b in _pack(rows, _PACKAGE)])
        self.last.update((max(initialState["day"]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, known = self._last(), {d: e for d, e in self.days.get()}
        for part in rows:
            part = part[part["day"] > done]
            for day, end in set(zip(part["day"], part["day_end"].astype(int))) - set(known.items()):
                known[day] = end
                self.days.appendValue((day, end))
                self.handle.registerTimer(end)
            for day, own in part[part["name"].notna()].groupby("day"):
                rows = list(zip(own["name"], own["version"], own["score"].astype(float).tolist(), own["listed"].astype(bool).tolist()))
                self.waiting.appendList([(day, b) for b in _pack(rows, _ROW)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a batch's first timer tells of all days that are complete, so their rows are read once
        now = timerValues.getCurrentWatermarkInMs()
        days = sorted(self.days.get())
        due = [d for d, end in days if end <= now]
        if not due:
            return
        waiting = list(self.waiting.get())
        before = {n: (v, s) for (block,) in self.packages.get() for n, v, s in _unpack(block)}
        done = self._last()
        for day in due:
            rows = {n: (v, s, known) for d, b in waiting if d == day for n, v, s, known in _unpack(b)}  # a repeated row is the same row
            out = [(key[0], day, *event) for event in self._check(before, rows, bool(done))]
            files = {n: x for n, x in before.items() if n.startswith(_FILE)}  # stay until they are seen again
            before, done = files | {n: (v, s) for n, (v, s, _) in rows.items()}, day
            yield pd.DataFrame(out, columns=["project_id", "check_day", "type", "severity", "package", "message"], dtype=object)
        _put(self.packages, [(b,) for b in _pack([(n, v, s) for n, (v, s) in before.items()], _PACKAGE)])
        _put(self.waiting, [w for w in waiting if w[0] > done])
        _put(self.days, [d for d in days if d[0] > done])
        self.last.update((done,))

    def _check(self, before: dict, rows: dict, checked: bool) -> Iterator[tuple]:
        changed = False
        for name, (version, score, listed) in rows.items():
            old_version, old_score = before.get(name, (None, 0.0))
            if name.startswith(_FILE):
                if old_version and version and old_version != version:
                    yield "lockfile-changed", "info", None, f"{name[1:]} has changed since last check"
                continue
            if name not in before:
                changed = True
                yield "package-added", "warning", name, f"New dependency added: {name}@{version}"
            elif old_version != version:
                changed = True
                yield "package-updated", "info", name, f"Dependency updated: {name} {old_version} -> {version}"
            if score > old_score and score >= self.threshold:
                yield "risk-increased", "critical", name, f"Risk score increased for {name}: {old_score:.1f} -> {score:.1f}"
            if not listed:
                yield "manifest-drift", "warning", name, f'Package "{name}" is installed but has no manifest entry'
        for name in before.keys() - rows.keys():
            if name.startswith(_FILE):
                continue
            changed = True
            yield "package-removed", "info", name, f"Dependency removed: {name}"
        if changed and checked:  # each part that changed says so; a batch's repeats are one event
            yield "lockfile-changed", "warning", None, "package-lock.json has changed since last check"


def _source(spark: SparkSession, source_dir: str, files_per_trigger: int, delay: str, schema: str = OBS_SCHEMA) -> DataFrame:
    # watermarks need a zoned timestamp; the observation time is local
    # (timestamp_ntz), so the event-time column is its session-zone cast
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
            .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"part": F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int"), "day": F.col("day").cast("string"),
                             "day_end": F.unix_millis(F.date_add("day", 1).cast("timestamp"))})


def _for_all_parts(rows: DataFrame) -> DataFrame:
    """Rows without a package, one for each key of their project."""
    return _keyed(rows.withColumns({"name": F.lit(None).cast("string"), "version": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _drain(spark: SparkSession, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream over all input that is there; the state is in RocksDB.  Each
    batch opens and commits the store of every state partition, also of those without
    a key, so there are no more than keep the cores busy."""
    old = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_PARTITIONS, min(int(spark.conf.get(_PARTITIONS)), 4 * spark.sparkContext.defaultParallelism))
    try:
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return q


def run_monitor_stream(spark: SparkSession, source_dir: str, manifest: DataFrame, work_dir: str, files_per_trigger: int = 16, delay: str = "1 day",
                       initial: DataFrame | None = None, threshold: float = H.RISK_THRESHOLD, files_dir: str | None = None) -> str:
    """Streams the observations that landed in ``source_dir`` so far, and the
    hashes of watched files in ``files_dir``; returns the events folder.  Called again with the same ``work_dir`` it goes on from its
    state.  ``delay`` is how late rows may come; ``initial`` are the rows of an
    init step, one check of each project, and seeds the state."""
    events = f"{work_dir}/events"
    # the static side is read by every micro-batch: materialise it once
    manifest.select("project_id", "name").distinct().withColumn("listed", F.lit(True)).write.mode("overwrite").parquet(f"{work_dir}/manifest")
    listed = spark.read.schema("project_id string, name string, listed boolean").parquet(f"{work_dir}/manifest")
    cols = ["project_id", "part", "day", "day_end", "name", "version", "score", "listed"]
    seen = _source(spark, source_dir, files_per_trigger, delay)
    # rows that say the input's end stay: a filter would run below the watermark and hide their time from it
    rows = _keyed(seen).join(listed, ["project_id", "name"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    checked = _source(spark, source_dir, files_per_trigger, delay).select("project_id", "day", "event_time").dropDuplicatesWithinWatermark(["project_id", "day"])
    checked = _for_all_parts(checked).withColumn("listed", F.lit(False))
    keyed = rows.select(*cols, "event_time").unionByName(checked.select(*cols, "event_time"))
    if files_dir is not None:
        watched = _source(spark, files_dir, files_per_trigger, delay, FILES_SCHEMA).withColumns(
            {"name": F.concat(F.lit(_FILE), F.col("file")), "version": F.col("hash"), "score": F.lit(0.0), "listed": F.lit(True)})
        keyed = keyed.unionByName(_keyed(watched).withColumn("part", F.lit(PARTS)).select(*cols, "event_time"))
    keyed = keyed.groupBy("project_id", "part")
    seed = None
    if initial is not None:
        first = initial.select("project_id", "day").distinct()
        seed = _keyed(initial).select("project_id", "part", "day", "name", "version", "score")
        seed = seed.unionByName(_for_all_parts(first).select(*seed.columns)).groupBy("project_id", "part")
    found = keyed.transformWithStateInPandas(Monitor(threshold), _EVENTS, "Append", "EventTime", initialState=seed)

    def write(batch: DataFrame, number: int) -> None:
        # the parts of a project complete a day in the same batch
        batch.dropDuplicates().withColumn("check_day", F.col("check_day").cast("date")).write.mode("overwrite").parquet(f"{events}/batch={number}")

    _drain(spark, found, write, f"{work_dir}/checkpoint")
    return events


def clear_events(spark: SparkSession, work_dir: str) -> None:
    """Forgets the events told so far; the monitor's state stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work_dir}/events")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_posture_stream(spark: SparkSession, source_dir: str, work_dir: str, files_per_trigger: int = 16, delay: str = "1 day") -> str:
    """M3 on a stream: tumbling windows aggregated in the state store and
    appended once the watermark has passed their end.  Repeated rows count once."""
    out = f"{work_dir}/windows"
    seen = _source(spark, source_dir, files_per_trigger, delay).dropDuplicatesWithinWatermark(["project_id", "name", "day"])
    windows = H.posture_windows(seen, "event_time").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

    def write(batch: DataFrame, number: int) -> None:
        batch.where("project_id != ''").write.mode("overwrite").parquet(f"{out}/batch={number}")  # the end of input is no project

    _drain(spark, windows, write, f"{work_dir}/checkpoint")
    return out


def end_input(spark: SparkSession, source_dir: str, last: DataFrame, delay: str = "1 day", schema: str = OBS_SCHEMA) -> None:
    """Lands the row by which a producer says that nothing more comes: no package
    or file, and a time that takes the watermark past the last day of ``last``
    (column ts).  Each source of a stream needs one."""
    end = last.agg(F.max("ts").alias("ts")).where("ts is not null")
    ts = F.col("ts") + F.expr(f"INTERVAL '{delay}'") + F.expr("INTERVAL 2 DAYS")
    known = {"project_id": F.lit(""), "ts": ts, "day": ts.cast("date")}
    fields = [f.split() for f in schema.split(", ")]
    end.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields]).write.mode("append").parquet(source_dir)


def replay_source(obs: DataFrame, target: str) -> None:
    """Land observations as an ordered sequence of appends (one per period of
    ``APPEND_DAYS`` days), the way a producer exports them; each append is written
    by as many tasks as the data has partitions."""
    first, last = obs.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    period = F.floor(F.datediff(F.col("day"), F.lit(first)) / F.lit(APPEND_DAYS)).cast("int")
    end = (last - first).days // APPEND_DAYS
    tagged = obs.withColumn("_period", F.coalesce(period, F.lit(end)))
    for p in range(end + 1):
        tagged.where(F.col("_period") == p).drop("_period").write.mode("append").parquet(target)


def _landed(spark: SparkSession, obs: DataFrame, name: str) -> tuple[str, str, DataFrame]:
    """Source folder, work folder and the observations as written once, for all appends."""
    work = shared_dir(spark, name)
    obs.select(*COLS).write.parquet(f"{work}/observed")
    obs = spark.read.schema(OBS_SCHEMA).parquet(f"{work}/observed")
    replay_source(obs, f"{work}/source")
    end_input(spark, f"{work}/source", obs, delay=f"{APPEND_DAYS} days")
    return f"{work}/source", work, obs


def posture_stream(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """M3 end to end: land the observations, stream them, read the windows."""
    source, work, _ = _landed(spark, obs, "posture-stream")
    return spark.read.parquet(run_posture_stream(spark, source, work, delay=f"{APPEND_DAYS} days")) \
        .select("project_id", "window_start", "observations", "max_risk", "high_risk")


def monitor_stream(spark: SparkSession, obs: DataFrame, manifest: DataFrame,
                   initial: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """M2 end to end: land the observations and the watched files' hashes
    (project_id, day, file, hash), stream them, read the events."""
    source, work, obs = _landed(spark, obs, "monitor-stream")
    folder = None
    if files is not None:
        folder = f"{work}/files"
        files.withColumn("ts", F.col("day").cast("timestamp_ntz")).select(*FILE_COLS).write.parquet(folder)
        end_input(spark, folder, obs, delay=f"{APPEND_DAYS} days", schema=FILES_SCHEMA)
    events = run_monitor_stream(spark, source, manifest, work, delay=f"{APPEND_DAYS} days", initial=initial, files_dir=folder)
    return spark.read.parquet(events).select(*H.EVENT_COLS)
