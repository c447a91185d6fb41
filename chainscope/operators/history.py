"""Monitoring and posture over time.

Input is an append-only observation table: one row per (project, check,
package) with the version and risk score seen at that check.  A check is a
(project, day) with observations.  Everything is windows over
(project, package) -- one row per check, so groups stay small -- and a
small per-project table of checks; no package set is collected into one
task (the lock hash is an order-free XOR of per-row 64-bit hashes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import top_k_per_group

RISK_THRESHOLD = 7.0
EVENT_ORDER = {"lockfile-changed": 0, "package-added": 1, "package-removed": 2, "package-updated": 3,
               "risk-increased": 4, "manifest-drift": 5}
EVENT_COLS = ["project_id", "check_day", "type", "severity", "package", "message"]


def checks(obs: DataFrame, project_col: str = "project_id", day_col: str = "day") -> DataFrame:
    """One row per (project, check) with the previous and next check."""
    w = Window.partitionBy(project_col).orderBy(day_col)
    return (obs.select(project_col, day_col).distinct()
            .withColumn("prev_check", F.lag(day_col).over(w))
            .withColumn("next_check", F.lead(day_col).over(w))
            .withColumn("check_no", F.row_number().over(w)))


def with_history(obs: DataFrame) -> DataFrame:
    """Observations with the package's previous/next observation and the
    project's previous/next check (W2)."""
    w = Window.partitionBy("project_id", "name").orderBy("day")
    c = checks(obs).drop("check_no")
    return (obs.join(c, ["project_id", "day"])
            .withColumn("prev_day", F.lag("day").over(w))
            .withColumn("prev_version", F.lag("version").over(w))
            .withColumn("prev_score", F.lag("score").over(w))
            .withColumn("next_day", F.lead("day").over(w)))


def _ev(df: DataFrame, day: Column, typ: str, sev: str, package: Column | None, message: Column) -> DataFrame:
    return df.select("project_id", day.alias("check_day"), F.lit(typ).alias("type"), F.lit(sev).alias("severity"),
                     (package if package is not None else F.lit(None).cast("string")).alias("package"),
                     message.alias("message"))


def _seen_before() -> Column:
    """The package was in the project's previous check."""
    return F.coalesce(F.col("prev_day") == F.col("prev_check"), F.lit(False))


def _event(cond: Column, day: Column, typ: str, sev: str, message: Column) -> Column:
    return F.when(cond, F.struct(day.alias("check_day"), F.lit(typ).alias("type"), F.lit(sev).alias("severity"), F.col("name").alias("package"), message.alias("message")))


def _package_events() -> list[Column]:
    """Added (warning), removed (info), updated (info) -- events of one observation with its history."""
    name, ver = F.col("name"), F.col("version")
    gone = F.col("next_check").isNotNull() & (F.col("next_day").isNull() | (F.col("next_day") != F.col("next_check")))
    return [_event(~_seen_before(), F.col("day"), "package-added", "warning", F.concat(F.lit("New dependency added: "), name, F.lit("@"), ver)),
            _event(gone, F.col("next_check"), "package-removed", "info", F.concat(F.lit("Dependency removed: "), name)),
            _event(_seen_before() & (F.col("prev_version") != ver), F.col("day"), "package-updated", "info",
                   F.concat(F.lit("Dependency updated: "), name, F.lit(" "), F.col("prev_version"), F.lit(" -> "), ver))]


def _risk_event(threshold: float) -> Column:
    """Score rose above the previous check's score (0 when the package
    was not scored there) and reaches the threshold (critical)."""
    old = F.when(_seen_before(), F.col("prev_score")).otherwise(F.lit(0.0))
    return _event((F.col("score") > old) & (F.col("score") >= threshold), F.col("day"), "risk-increased", "critical",
                  F.concat(F.lit("Risk score increased for "), F.col("name"), F.lit(": "), F.format_string("%.1f", old), F.lit(" -> "), F.format_string("%.1f", "score")))


def _drift_event() -> Column:
    """An installed package without a manifest entry (column ``listed``), at every check."""
    return _event(~F.col("listed"), F.col("day"), "manifest-drift", "warning",
                  F.concat(F.lit('Package "'), F.col("name"), F.lit('" is installed but has no manifest entry')))


def _told(rows: DataFrame, events: list[Column]) -> DataFrame:
    """The events of each row, which is computed once however many there are."""
    return rows.select("project_id", F.explode_outer(F.array_compact(F.array(*events))).alias("_e")).where(F.col("_e").isNotNull()).select("project_id", "_e.*")


def _listed(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    entries = manifest.select("project_id", "name").distinct().withColumn("listed", F.lit(True))
    return rows.join(entries, ["project_id", "name"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def package_events(h: DataFrame) -> DataFrame:
    """Events of packages that came, went or changed."""
    return _told(h, _package_events())


def risk_events(h: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Events of scores that rose to the threshold."""
    return _told(h, [_risk_event(threshold)])


def lock_hashes(obs: DataFrame) -> DataFrame:
    """Content hash of each check's package set: XOR of 64-bit row hashes
    (commutative, partial-aggregated), compared with the previous check."""
    w = Window.partitionBy("project_id").orderBy("day")
    return (obs.groupBy("project_id", "day").agg(F.bit_xor(F.xxhash64("name", "version")).alias("lock_hash"))
            .withColumn("prev_hash", F.lag("lock_hash").over(w)))


def file_events(obs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Lock content changed since the previous check (warning); with
    ``files`` (project_id, day, file, hash: watched files at each check) also
    their changes (info).  A file that was absent or is now has no event."""
    h = lock_hashes(obs).where(F.col("prev_hash").isNotNull() & (F.col("prev_hash") != F.col("lock_hash")))
    out = _ev(h, F.col("day"), "lockfile-changed", "warning", None,
              F.lit("package-lock.json has changed since last check"))
    if files is None:
        return out
    w = Window.partitionBy("project_id", "file").orderBy("day")
    f = files.withColumn("_prev", F.lag("hash").over(w)).where((F.col("_prev") != F.col("hash")) & (F.col("_prev") != "") & (F.col("hash") != ""))
    return out.unionByName(_ev(f, F.col("day"), "lockfile-changed", "info", None, F.concat("file", F.lit(" has changed since last check"))))


def drift_events(obs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Installed packages without a manifest entry, at every check."""
    return _told(_listed(obs, manifest), [_drift_event()])


def monitor_check(obs: DataFrame, manifest: DataFrame | None = None, threshold: float = RISK_THRESHOLD,
                  initial: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """M1: every event of every check, batch form of the monitor.  ``files`` are
    the watched files' hashes at each check.

    ``initial`` is the state an init step recorded (rows of one earlier
    check per project): its packages are known, so they are not reported
    as added at the first check, and no events are emitted for it.
    """
    if initial is not None:
        first = obs.groupBy("project_id").agg(F.min("day").alias("_first"))
        init = (initial.join(first, "project_id").where(F.col("day") < F.col("_first")).drop("_first")
                .select(*obs.columns))
        ev = monitor_check(init.unionByName(obs), manifest, threshold, files=files)
        checks_ = obs.select("project_id", F.col("day").alias("check_day")).distinct()
        return ev.join(checks_, ["project_id", "check_day"], "left_semi")
    h = with_history(obs)
    events = [*_package_events(), _risk_event(threshold)]
    if manifest is not None:
        h, events = _listed(h, manifest), [*events, _drift_event()]
    return file_events(obs, files).unionByName(_told(h, events))


def init_state(obs: DataFrame) -> DataFrame:
    """S13 init: rows of the first check of every project (per-project
    minimum by aggregation, joined back; no window over a whole project)."""
    first = obs.groupBy("project_id").agg(F.min("day").alias("_first"))
    return obs.join(first, "project_id").where(F.col("day") == F.col("_first")).drop("_first")


def event_rank(ev: DataFrame) -> Column:
    order = js.rank_of(F.col("type"), EVENT_ORDER)
    return [F.col("check_day").desc(), order, F.col("package"), F.col("message")]


def recent_events(ev: DataFrame, k: int) -> DataFrame:
    """Newest k events per project (newest check first, then event
    order).  row_number <= k gets a per-partition limit before the
    shuffle, so a busy project does not move all its events."""
    return top_k_per_group(ev, ["project_id"], event_rank(ev), k)


def monitor_status(ev: DataFrame, obs: DataFrame, recent: int = 10) -> DataFrame:
    """Last check, checks performed, alert counts among the last 10
    events, tracked packages at the last check, summary sentence."""
    r = recent_events(ev, recent).groupBy("project_id").agg(
        F.count(F.when(F.col("severity") == "critical", 1)).cast("bigint").alias("critical"),
        F.count(F.when(F.col("severity") == "warning", 1)).cast("bigint").alias("warning"))
    c = checks(obs).groupBy("project_id").agg(F.max("day").alias("last_check"),
                                              F.count("*").cast("bigint").alias("checks_performed"))
    tracked = (obs.join(c, "project_id").where(F.col("day") == F.col("last_check"))
               .groupBy("project_id").agg(F.count("*").cast("bigint").alias("tracked_packages")))
    out = c.join(tracked, "project_id", "left").join(r, "project_id", "left").fillna(0, ["critical", "warning"])
    summary = (F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical alert(s) detected")))
               .when(F.col("warning") > 0, F.concat(F.col("warning").cast("string"), F.lit(" warning(s) since last check")))
               .otherwise(F.lit("All clear — no issues detected")))
    return out.withColumn("summary", summary)


# ---------------------------------------------------------------- posture

METRICS = ["total_findings", "critical_findings", "high_findings", "license_violations", "policy_violations", "provenance_coverage",
           "manifest_coverage"]


def with_metrics(snaps: DataFrame, readings: DataFrame) -> DataFrame:
    """Point-in-time join: each snapshot with the newest reading (project_id, day,
    metric, value) of every metric at or before its day, 0 where there is none.

    Readings and snapshots are one ordered sequence per project, in which the
    last value of each metric is carried forward: one window, no range join.  Of
    several readings of a metric on a day the largest counts."""
    none = F.lit(None).cast("double")
    wide = readings.groupBy("project_id", "day").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS])
    rows = snaps.select("project_id", "day", F.struct(*[c for c in snaps.columns if c not in ("project_id", "day")]).alias("_snap"), *[none.alias(m) for m in METRICS])
    told = wide.select("project_id", "day", F.lit(None).cast(rows.schema["_snap"].dataType).alias("_snap"), *METRICS)
    # a day's readings come before its snapshot
    w = Window.partitionBy("project_id").orderBy("day", F.col("_snap").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.coalesce(F.last(m, ignorenulls=True).over(w), F.lit(0.0)).alias(m) for m in METRICS]
    return rows.unionByName(told).select("project_id", "day", "_snap", *carried).where(F.col("_snap").isNotNull()).select("project_id", "day", "_snap.*", *METRICS)


def posture_snapshots(obs: DataFrame, threshold: float = RISK_THRESHOLD, readings: DataFrame | None = None) -> DataFrame:
    """One snapshot per (project, day).  Scores are summed as exact
    decimals so the mean does not depend on summation order.  With ``readings``
    it holds the other metrics as they were known that day."""
    s = F.col("score").cast("decimal(18,6)")
    agg = obs.groupBy("project_id", "day").agg(
        F.count("*").cast("bigint").alias("package_count"),
        F.sum(s).alias("_sum"), F.max("score").alias("max_risk"),
        F.count(F.when(F.col("score") >= threshold, 1)).cast("bigint").alias("high_risk"))
    avg = F.col("_sum").cast("double") / F.col("package_count")
    snaps = (agg.withColumn("average_risk", js.round1(avg))
             .withColumn("overall_score", js.js_round((F.lit(10.0) - avg) * 10.0))
             .drop("_sum"))
    return snaps if readings is None else with_metrics(snaps, readings)


def high_risk_packages(obs: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """The names behind a snapshot's high_risk, as rows."""
    return obs.where(F.col("score") >= threshold).select("project_id", "day", F.col("name").alias("package"), "score")


def latest_snapshots(snaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest ``limit`` snapshots per project (all unless given), numbered oldest first."""
    if limit is None:
        return snaps.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy("day")).cast("bigint"))
    top = top_k_per_group(snaps, ["project_id"], [F.col("day").desc()], limit, name="_r")
    n = F.count("*").over(Window.partitionBy("project_id"))
    return top.withColumn("position", (n - F.col("_r") + 1).cast("bigint")).drop("_r")


# FIXED VALUES — sentences of the trend: metric, text when it fell, text when it rose (None: none), as a decimal number
TREND_PARTS = [("average_risk", "Average risk reduced", "Average risk increased"), ("high_risk", "High-risk packages reduced", "High-risk packages increased"),
               ("total_findings", "Total findings reduced", "Total findings increased"), ("license_violations", "License violations reduced", None)]


def posture_trend(snaps: DataFrame, limit: int | None = None) -> DataFrame:
    """First vs last of the loaded snapshots per project, with what got
    better and worse in words (joined by '; ')."""
    last = latest_snapshots(snaps, limit)
    parts = [p for p in TREND_PARTS if p[0] in snaps.columns]
    m = F.struct("day", "overall_score", *[p[0] for p in parts])
    g = last.groupBy("project_id").agg(F.count("*").cast("bigint").alias("snapshots"),
                                       F.min(m).alias("f"), F.max(m).alias("l"))
    diff = F.col("l.overall_score") - F.col("f.overall_score")
    pct = F.when(F.col("f.overall_score") > 0,
                 js.js_round(diff.cast("double") / F.col("f.overall_score") * 100.0)).otherwise(F.lit(0)).cast("bigint")
    trend = F.when(F.col("snapshots") < 2, "stable").when(diff > 2, "improving").when(diff < -2, "declining").otherwise("stable")
    pct = F.when(F.col("snapshots") < 2, F.lit(0).cast("bigint")).otherwise(pct)
    word = F.when(F.col("trend") == "improving", "up").when(F.col("trend") == "declining", "down").otherwise("stable")
    summary = F.when(F.col("snapshots") == 1, F.concat(F.lit("Current posture score: "),
                                                       F.col("f.overall_score").cast("string"), F.lit("/100"))).otherwise(
        F.concat(F.lit("Posture "), word, F.lit(": "), F.col("f.overall_score").cast("string"), F.lit("/100 -> "),
                 F.col("l.overall_score").cast("string"), F.lit("/100 ("),
                 F.when(F.col("change_percent") >= 0, "+").otherwise(""), F.col("change_percent").cast("string"),
                 F.lit("%) over "), F.col("snapshots").cast("string"), F.lit(" snapshots")))

    def told(metric: str, text: str | None, fell: bool) -> Column:
        before, after = F.col(f"f.{metric}").cast("double"), F.col(f"l.{metric}").cast("double")
        hit = (after < before) if fell else (after > before)
        return F.when(hit & F.lit(text is not None), F.concat(F.lit(f"{text}: "), js.js_num(before), F.lit(" -> "), js.js_num(after)))

    return (g.withColumn("trend", trend).withColumn("change_percent", pct)
            .withColumn("summary", summary)
            .withColumn("improvements", F.concat_ws("; ", *[told(c, t, True) for c, t, _ in parts]))
            .withColumn("regressions", F.concat_ws("; ", *[told(c, t, False) for c, _, t in parts]))
            .select("project_id", "snapshots", F.col("f.day").alias("period_start"), F.col("l.day").alias("period_end"),
                    F.col("f.overall_score").alias("first_score"), F.col("l.overall_score").alias("last_score"),
                    "change_percent", "trend", "improvements", "regressions", "summary"))


# FIXED VALUES — compared metrics (label, snapshot column, higher is better)
COMPARED = [("Overall Score", "overall_score", True), ("Average Risk", "average_risk", False),
            ("Max Risk", "max_risk", False), ("Total Findings", "total_findings", False),
            ("Critical Findings", "critical_findings", False), ("High Findings", "high_findings", False),
            ("License Violations", "license_violations", False), ("Policy Violations", "policy_violations", False),
            ("Provenance Coverage", "provenance_coverage", True), ("Manifest Coverage", "manifest_coverage", True)]


def posture_compare(snaps: DataFrame) -> DataFrame:
    """Each snapshot against the previous one, metric by metric (those
    that the snapshots hold)."""
    w = Window.partitionBy("project_id").orderBy("day")
    rows = []
    for label, col, higher_better in COMPARED:
        if col in snaps.columns:
            val = F.col(col).cast("double")
            rows.append(F.struct(F.lit(label).alias("metric"), F.lag(val).over(w).alias("before"),
                                 val.alias("after"), F.lit(higher_better).alias("hb")))
    x = (snaps.select("project_id", "day", F.array(*rows).alias("_ms"))
         .select("project_id", "day", F.explode("_ms").alias("m")).where(F.col("m.before").isNotNull()))
    change = F.col("m.after") - F.col("m.before")
    direction = (F.when(change == 0, "unchanged")
                 .when(F.col("m.hb"), F.when(change > 0, "improved").otherwise("regressed"))
                 .otherwise(F.when(change < 0, "improved").otherwise("regressed")))
    return x.select("project_id", "day", F.col("m.metric").alias("metric"), F.col("m.before").alias("before"),
                    F.col("m.after").alias("after"), change.alias("change"), direction.alias("direction"))


def posture_compare_summary(changes: DataFrame) -> DataFrame:
    """Of each comparison, how many metrics went which way, and the whole."""
    n = {d: F.count(F.when(F.col("direction") == d, 1)).cast("bigint").alias(d) for d in ("improved", "regressed", "unchanged")}
    out = changes.groupBy("project_id", "day").agg(*n.values())
    i, r = F.col("improved"), F.col("regressed")
    return (out.withColumn("overall_change", F.when(i > r, "improving").when(r > i, "declining").otherwise("stable"))
            .withColumn("summary", F.concat(i.cast("string"), F.lit(" metrics improved, "), r.cast("string"), F.lit(" regressed, "),
                                            F.col("unchanged").cast("string"), F.lit(" unchanged"))))


def posture_windows(obs: DataFrame, ts_col: str = "ts", width: str = "1 day") -> DataFrame:
    """M3: tumbling-window posture per project (batch; the streaming form
    runs the same aggregate with a watermark)."""
    return (obs.groupBy("project_id", F.window(ts_col, width).alias("w"))
            .agg(F.count("*").cast("bigint").alias("observations"), F.max("score").alias("max_risk"),
                 F.count(F.when(F.col("score") >= RISK_THRESHOLD, 1)).cast("bigint").alias("high_risk"))
            .select("project_id", F.col("w.start").alias("window_start"), "observations", "max_risk", "high_risk"))
