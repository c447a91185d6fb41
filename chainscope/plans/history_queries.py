"""Monitor and posture queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chainscope.operators import history as H
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures

EV = ", ".join(H.EVENT_COLS)


def obs(ws):
    return ws.table("observations")


def snaps(ws):
    return H.posture_snapshots(obs(ws), readings=ws.table("metric_readings"))


# ------------------------------------------------------------------ oracle

def o_history():
    return [
        ("chk", """
SELECT project_id, day, lag(day) OVER (PARTITION BY project_id ORDER BY day) AS prev_check,
       lead(day) OVER (PARTITION BY project_id ORDER BY day) AS next_check
FROM (SELECT DISTINCT project_id, day FROM observations)"""),
        ("h", """
SELECT o.*, c.prev_check, c.next_check,
       lag(o.day) OVER w AS prev_day, lag(o.version) OVER w AS prev_version,
       lag(o.score) OVER w AS prev_score, lead(o.day) OVER w AS next_day,
       coalesce(lag(o.day) OVER w = c.prev_check, FALSE) AS seen_before
FROM observations o JOIN chk c ON o.project_id = c.project_id AND o.day = c.day
WINDOW w AS (PARTITION BY o.project_id, o.name ORDER BY o.day)"""),
        ("lk", """
SELECT project_id, day, content, lag(content) OVER (PARTITION BY project_id ORDER BY day) AS prev_content
FROM (SELECT project_id, day, string_agg(name || '@' || version, ',' ORDER BY name) AS content
      FROM observations GROUP BY project_id, day)"""),
        ("ev_file", """
SELECT project_id, day AS check_day, 'lockfile-changed' AS type, 'warning' AS severity, CAST(NULL AS VARCHAR) AS package,
       'package-lock.json has changed since last check' AS message
FROM lk WHERE prev_content IS NOT NULL AND prev_content <> content"""),
        ("ev_pkg", """
SELECT project_id, day AS check_day, 'package-added' AS type, 'warning' AS severity, name AS package,
       'New dependency added: ' || name || '@' || version AS message FROM h WHERE NOT seen_before
UNION ALL
SELECT project_id, next_check, 'package-removed', 'info', name, 'Dependency removed: ' || name
FROM h WHERE next_check IS NOT NULL AND (next_day IS NULL OR next_day <> next_check)
UNION ALL
SELECT project_id, day, 'package-updated', 'info', name,
       'Dependency updated: ' || name || ' ' || prev_version || ' -> ' || version
FROM h WHERE seen_before AND prev_version <> version"""),
        ("ev_risk", f"""
SELECT project_id, day AS check_day, 'risk-increased' AS type, 'critical' AS severity, name AS package,
       'Risk score increased for ' || name || ': ' || printf('%.1f', old) || ' -> ' || printf('%.1f', score) AS message
FROM (SELECT *, CASE WHEN seen_before THEN prev_score ELSE 0.0 END AS old FROM h)
WHERE score > old AND score >= {H.RISK_THRESHOLD}"""),
        ("ev_drift", """
SELECT o.project_id, o.day AS check_day, 'manifest-drift' AS type, 'warning' AS severity, o.name AS package,
       'Package "' || o.name || '" is installed but has no manifest entry' AS message
FROM observations o
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.project_id = o.project_id AND m.name = o.name)"""),
        ("ev_json", """
SELECT project_id, day AS check_day, 'lockfile-changed' AS type, 'info' AS severity, CAST(NULL AS VARCHAR) AS package,
       'package.json has changed since last check' AS message
FROM (SELECT *, lag(hash) OVER (PARTITION BY project_id, file ORDER BY day) AS prev FROM watched_files) WHERE prev <> hash"""),
        ("ev", "SELECT * FROM ev_file UNION ALL SELECT * FROM ev_pkg UNION ALL SELECT * FROM ev_risk "
               "UNION ALL SELECT * FROM ev_drift"),
        ("ev_ranked", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY check_day DESC,
  CASE type {' '.join(f"WHEN '{t}' THEN {i}" for t, i in H.EVENT_ORDER.items())} END, package, message) AS BIGINT) AS rank
FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev_json)"""),
    ]


def o_posture():
    asof = [(f"as_{m}", f"""
SELECT ps1.project_id, ps1.day, coalesce(r.value, 0) AS {m} FROM ps1
ASOF LEFT JOIN (SELECT * FROM metric_readings WHERE metric = '{m}') r ON ps1.project_id = r.project_id AND ps1.day >= r.day""") for m in H.METRICS]
    joins = " ".join(f"JOIN as_{m} USING (project_id, day)" for m in H.METRICS)
    return [
        ("ps0", """
SELECT project_id, day, CAST(count(*) AS BIGINT) AS package_count,
       CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_score,
       max(score) AS max_risk, CAST(count_if(score >= 7.0) AS BIGINT) AS high_risk
FROM observations GROUP BY project_id, day"""),
        ("ps1", f"""
SELECT project_id, day, package_count, max_risk, high_risk, {Q.round1('avg_score')} AS average_risk,
       {Q.js_round('(10.0 - avg_score) * 10.0')} AS overall_score
FROM ps0"""),
        *asof,
        ("ps", f"SELECT ps1.*, {', '.join(H.METRICS)} FROM ps1 {joins}"),
        ("latest", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day DESC) AS r,
         count(*) OVER (PARTITION BY project_id) AS n FROM ps)"""),
    ]


POSTURE = ["observations", "metric_readings"]
HIST = ["observations", "manifest", "watched_files"]

def _numbers(sql):
    """@x stands for the number x as JavaScript prints it."""
    return re.sub(r"@(\w+)", lambda m: Q.js_num(m[1]), sql)


# ------------------------------------------------------------------ queries


def events(ws):
    return H.monitor_check(obs(ws), ws.table("manifest"), files=ws.table("watched_files"))


@query("monitor_check", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev UNION ALL SELECT {EV} FROM ev_json"))
def q_monitor_check(ws):
    return events(ws).select(*H.EVENT_COLS)


@query("monitor_file_events", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev_file UNION ALL SELECT {EV} FROM ev_json"))
def q_monitor_file_events(ws):
    return H.file_events(obs(ws), ws.table("watched_files")).select(*H.EVENT_COLS)


@query("monitor_package_events", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev_pkg"))
def q_monitor_package_events(ws):
    return H.package_events(H.with_history(obs(ws))).select(*H.EVENT_COLS)


@query("monitor_risk_events", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev_risk"))
def q_monitor_risk_events(ws):
    return H.risk_events(H.with_history(obs(ws))).select(*H.EVENT_COLS)


@query("manifest_drift", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev_drift"))
def q_manifest_drift(ws):
    return H.drift_events(obs(ws), ws.table("manifest")).select(*H.EVENT_COLS)


@query("monitor_recent_events", lambda: with_fixtures(HIST, o_history(),
                                                      f"SELECT {EV}, rank FROM ev_ranked WHERE rank <= 100"))
def q_monitor_recent_events(ws):
    return H.recent_events(events(ws), 100).select(*H.EVENT_COLS, "rank")


@query("monitor_status", lambda: with_fixtures(HIST, o_history() + [
    ("r10", """SELECT project_id, CAST(count_if(severity = 'critical') AS BIGINT) AS critical,
                      CAST(count_if(severity = 'warning') AS BIGINT) AS warning
               FROM ev_ranked WHERE rank <= 10 GROUP BY project_id"""),
    ("cs", """SELECT project_id, max(day) AS last_check, CAST(count(*) AS BIGINT) AS checks_performed
              FROM chk GROUP BY project_id"""),
    ("tr", """SELECT o.project_id, CAST(count(*) AS BIGINT) AS tracked_packages FROM observations o
              JOIN cs ON o.project_id = cs.project_id AND o.day = cs.last_check GROUP BY o.project_id"""),
], """
SELECT cs.project_id, last_check, checks_performed, tracked_packages,
       coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning,
       CASE WHEN coalesce(critical, 0) > 0 THEN CAST(critical AS VARCHAR) || ' critical alert(s) detected'
            WHEN coalesce(warning, 0) > 0 THEN CAST(warning AS VARCHAR) || ' warning(s) since last check'
            ELSE 'All clear — no issues detected' END AS summary
FROM cs LEFT JOIN tr USING (project_id) LEFT JOIN r10 USING (project_id)"""))
def q_monitor_status(ws):
    return H.monitor_status(events(ws), obs(ws))


@query("posture_snapshots", lambda: with_fixtures(POSTURE, o_posture(), "SELECT * FROM ps"))
def q_posture_snapshots(ws):
    return snaps(ws).select("project_id", "day", "package_count", "max_risk", "high_risk", "average_risk",
                            "overall_score", *H.METRICS)


@query("posture_high_risk", lambda: with_fixtures(["observations"], [], f"""
SELECT project_id, day, name AS package, score FROM observations WHERE score >= {H.RISK_THRESHOLD}"""))
def q_posture_high_risk(ws):
    return H.high_risk_packages(obs(ws))


@query("latest_snapshots", lambda: with_fixtures(POSTURE, o_posture(), """
SELECT project_id, day, CAST(n - r + 1 AS BIGINT) AS position, overall_score FROM latest"""))
def q_latest_snapshots(ws):
    return H.latest_snapshots(snaps(ws)).select("project_id", "day", "position", "overall_score")


@query("posture_trend", lambda: with_fixtures(POSTURE, o_posture() + [
    ("fl", """
SELECT project_id, CAST(count(*) AS BIGINT) AS snapshots,
       min(day) AS period_start, max(day) AS period_end,
       arg_min(overall_score, day) AS first_score, arg_max(overall_score, day) AS last_score,
       arg_min(average_risk, day) AS fa, arg_max(average_risk, day) AS la,
       arg_min(high_risk, day) AS fh, arg_max(high_risk, day) AS lh,
       arg_min(total_findings, day) AS ff, arg_max(total_findings, day) AS lf,
       arg_min(license_violations, day) AS fv, arg_max(license_violations, day) AS lv
FROM latest GROUP BY project_id"""),
    ("t0", f"""
SELECT *, last_score - first_score AS diff,
       CAST(CASE WHEN snapshots < 2 THEN 0 WHEN first_score > 0
                 THEN {Q.js_round('CAST(last_score - first_score AS DOUBLE) / first_score * 100.0')} ELSE 0 END AS BIGINT)
         AS change_percent
FROM fl"""),
    ("t1", """
SELECT *, CASE WHEN snapshots < 2 THEN 'stable' WHEN diff > 2 THEN 'improving' WHEN diff < -2 THEN 'declining'
               ELSE 'stable' END AS trend FROM t0"""),
], _numbers("""
SELECT project_id, snapshots, period_start, period_end, first_score, last_score, change_percent, trend,
       concat_ws('; ', CASE WHEN la < fa THEN 'Average risk reduced: ' || @fa || ' -> ' || @la END,
                 CASE WHEN lh < fh THEN 'High-risk packages reduced: ' || @fh || ' -> ' || @lh END,
                 CASE WHEN lf < ff THEN 'Total findings reduced: ' || @ff || ' -> ' || @lf END,
                 CASE WHEN lv < fv THEN 'License violations reduced: ' || @fv || ' -> ' || @lv END) AS improvements,
       concat_ws('; ', CASE WHEN la > fa THEN 'Average risk increased: ' || @fa || ' -> ' || @la END,
                 CASE WHEN lh > fh THEN 'High-risk packages increased: ' || @fh || ' -> ' || @lh END,
                 CASE WHEN lf > ff THEN 'Total findings increased: ' || @ff || ' -> ' || @lf END) AS regressions,
       CASE WHEN snapshots = 1 THEN 'Current posture score: ' || CAST(first_score AS VARCHAR) || '/100'
            ELSE 'Posture ' || CASE trend WHEN 'improving' THEN 'up' WHEN 'declining' THEN 'down' ELSE 'stable' END
                 || ': ' || CAST(first_score AS VARCHAR) || '/100 -> ' || CAST(last_score AS VARCHAR) || '/100 ('
                 || CASE WHEN change_percent >= 0 THEN '+' ELSE '' END || CAST(change_percent AS VARCHAR)
                 || '%) over ' || CAST(snapshots AS VARCHAR) || ' snapshots' END AS summary
FROM t1""")))
def q_posture_trend(ws):
    return H.posture_trend(snaps(ws))


def _o_compare():
    parts = []
    for label, col, hb in H.COMPARED:
        after = f"CAST({col} AS DOUBLE)"
        parts.append(f"""SELECT project_id, day, '{label}' AS metric,
       lag({after}) OVER (PARTITION BY project_id ORDER BY day) AS before, {after} AS after, {str(hb).upper()} AS hb
FROM ps""")
    return [("pc0", "\nUNION ALL\n".join(parts)), ("pc", """
SELECT project_id, day, metric, before, after, after - before AS change,
       CASE WHEN after - before = 0 THEN 'unchanged'
            WHEN hb THEN CASE WHEN after - before > 0 THEN 'improved' ELSE 'regressed' END
            ELSE CASE WHEN after - before < 0 THEN 'improved' ELSE 'regressed' END END AS direction
FROM pc0 WHERE before IS NOT NULL""")]


@query("posture_compare", lambda: with_fixtures(POSTURE, o_posture() + _o_compare(), "SELECT * FROM pc"))
def q_posture_compare(ws):
    return H.posture_compare(snaps(ws))


@query("posture_compare_summary", lambda: with_fixtures(POSTURE, o_posture() + _o_compare() + [("pcs", """
SELECT project_id, day, CAST(count_if(direction = 'improved') AS BIGINT) AS improved, CAST(count_if(direction = 'regressed') AS BIGINT) AS regressed,
       CAST(count_if(direction = 'unchanged') AS BIGINT) AS unchanged FROM pc GROUP BY project_id, day""")], """
SELECT *, CASE WHEN improved > regressed THEN 'improving' WHEN regressed > improved THEN 'declining' ELSE 'stable' END AS overall_change,
       improved || ' metrics improved, ' || regressed || ' regressed, ' || unchanged || ' unchanged' AS summary FROM pcs"""))
def q_posture_compare_summary(ws):
    return H.posture_compare_summary(H.posture_compare(snaps(ws)))


@query("posture_windows", lambda: with_fixtures(["observations"], [], f"""
SELECT project_id, date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS observations,
       max(score) AS max_risk, CAST(count_if(score >= {H.RISK_THRESHOLD}) AS BIGINT) AS high_risk
FROM observations GROUP BY project_id, date_trunc('day', ts)"""))
def q_posture_windows(ws):
    return H.posture_windows(obs(ws))


@query("monitor_stream", lambda: with_fixtures(HIST, o_history(), f"SELECT {EV} FROM ev UNION ALL SELECT {EV} FROM ev_json"))
def q_monitor_stream(ws):
    """M2: the monitor as a Structured Streaming job over landed
    observation files; its events must equal the batch monitor's."""
    from chainscope.streaming.monitor import monitor_stream
    return monitor_stream(ws.spark, obs(ws), ws.table("manifest"), files=ws.table("watched_files"))


@query("posture_windows_stream", lambda: with_fixtures(["observations"], [], f"""
SELECT project_id, date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS observations,
       max(score) AS max_risk, CAST(count_if(score >= {H.RISK_THRESHOLD}) AS BIGINT) AS high_risk
FROM observations GROUP BY project_id, date_trunc('day', ts)"""))
def q_posture_windows_stream(ws):
    """M3 on Structured Streaming: the same windows, emitted per complete day."""
    from chainscope.streaming.monitor import posture_stream
    return posture_stream(ws.spark, obs(ws))


@query("monitor_init_check", lambda: with_fixtures(HIST, o_history(), f"""
SELECT {EV} FROM ev
WHERE check_day > (SELECT min(o.day) FROM observations o WHERE o.project_id = ev.project_id)"""))
def q_monitor_init_check(ws):
    """Monitor initialised with each project's first check, then run
    over the later checks."""
    o = obs(ws)
    init = H.init_state(o)
    rest = o.join(init.select("project_id", F.col("day").alias("_d")).distinct(), "project_id") \
        .where(F.col("day") > F.col("_d")).drop("_d")
    return H.monitor_check(rest, ws.table("manifest"), initial=init).select(*H.EVENT_COLS)
