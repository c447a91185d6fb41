"""Name similarity and lockfile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainscope.catalog.reference import KNOWN_SCOPES, POPULAR_PACKAGES
from chainscope.functions.regex import sql_str
from chainscope.operators import lockdiff, names
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures

KNOWN_SQL = ", ".join(sql_str(k) for k in POPULAR_PACKAGES)
SCOPES_SQL = "[" + ", ".join(sql_str(s) for s in KNOWN_SCOPES) + "]"
SCOPED = "'^(@[^/]+)/(.+)$'"


# ------------------------------------------------------------------ names

def o_names():
    return [
        ("known", Q.values_cte(["known_idx", "known"], list(enumerate(POPULAR_PACKAGES)))),
        ("ns", f"""
SELECT DISTINCT name, regexp_extract(name, {SCOPED}, 1) AS scope,
       CASE WHEN regexp_extract(name, {SCOPED}, 1) = '' THEN name ELSE regexp_extract(name, {SCOPED}, 2) END AS base
FROM pkg_names"""),
        ("nk", f"SELECT * FROM ns WHERE name NOT IN ({KNOWN_SQL}) AND base NOT IN ({KNOWN_SQL})"),
        ("nh", f"""
SELECT *, CASE WHEN scope <> '' THEN list_filter({SCOPES_SQL}, lambda s: s <> scope AND levenshtein(scope, s) <= 2)[1]
          END AS hit FROM nk"""),
        ("pairs", """
SELECT n.name, n.scope, n.base, k.known_idx, k.known, k.known AS kbase,
       list_filter(range(1, length(n.base) + 1), lambda i: substr(n.base, i, 1) <> substr(k.known, i, 1)) AS d
FROM nh n JOIN known k ON abs(length(n.base) - length(k.known)) <= 2"""),
        ("feat", """
SELECT name, base, known_idx, known,
       replace(replace(replace(base, '-', ''), '_', ''), '.', '') = replace(replace(replace(known, '-', ''), '_', ''), '.', '')
         AND base <> known AS separator,
       length(base) = length(known) AND length(base) > 0 AND len(d) = 2 AND d[2] - d[1] = 1
         AND substr(base, d[1], 1) = substr(known, d[2], 1) AND substr(base, d[2], 1) = substr(known, d[1], 1) AS swap,
       length(base) = length(known) + 1 AND list_bool_or(list_transform(range(1, length(base) + 1),
         lambda i: substr(base, 1, i - 1) || substr(base, i + 1) = known)) AS extra,
       length(known) = length(base) + 1 AND list_bool_or(list_transform(range(1, length(known) + 1),
         lambda i: substr(known, 1, i - 1) || substr(known, i + 1) = base)) AS missing,
       CAST(levenshtein(base, known) AS INTEGER) AS lev
FROM pairs"""),
    ]


def o_typosquat():
    return o_names() + [
        ("meth", """
SELECT *, CASE WHEN separator THEN 'hyphen-underscore' WHEN swap THEN 'character-swap'
               WHEN extra THEN 'repeated-character' WHEN missing THEN 'missing-character' END AS dm
FROM feat WHERE name IN (SELECT name FROM nh WHERE hit IS NULL)"""),
        ("cand", """
SELECT name, known_idx, known, dm IS NOT NULL AS direct, coalesce(dm, 'levenshtein') AS method,
       CAST(CASE WHEN dm = 'hyphen-underscore' THEN 0 WHEN dm IS NOT NULL THEN 1 ELSE lev END AS INTEGER) AS distance
FROM meth WHERE dm IS NOT NULL OR lev <= 2"""),
        ("best", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN direct THEN 0 ELSE 1 END,
           CASE WHEN direct THEN known_idx ELSE distance END, known_idx) AS rn FROM cand) WHERE rn = 1"""),
        ("ty", """
SELECT name, hit || '/' || base AS similar_to, CAST(levenshtein(scope, hit) AS INTEGER) AS distance,
       'scope-confusion' AS method FROM nh WHERE hit IS NOT NULL
UNION ALL
SELECT name, known AS similar_to, distance, method FROM best"""),
    ]


def pkg_names(ws):
    return ws.table("pkg_names")


@query("typosquat", lambda: with_fixtures(["pkg_names"], o_typosquat(), "SELECT * FROM ty"))
def q_typosquat(ws):
    return names.typosquat(pkg_names(ws), names.known_frame(ws.spark)).select("name", "similar_to", "distance",
                                                                               "method")


@query("scope_confusion", lambda: with_fixtures(["pkg_names"], o_names(), """
SELECT name, hit || '/' || base AS similar_to, CAST(levenshtein(scope, hit) AS INTEGER) AS distance,
       'scope-confusion' AS method FROM nh WHERE hit IS NOT NULL"""))
def q_scope_confusion(ws):
    d = pkg_names(ws).select("name").distinct()
    _, base = names.split_name(F.col("name"))
    d = d.where(~(F.col("name").isin(POPULAR_PACKAGES) | base.isin(POPULAR_PACKAGES)))
    return names.scope_confusion(d)


@query("name_distance", lambda: with_fixtures(["pkg_names"], o_names(), """
SELECT name, known, lev AS distance FROM feat WHERE lev <= 2"""))
def q_name_distance(ws):
    d = pkg_names(ws).select("name").distinct()
    _, base = names.split_name(F.col("name"))
    d = d.where(~(F.col("name").isin(POPULAR_PACKAGES) | base.isin(POPULAR_PACKAGES)))
    f = names.pair_features(names.candidate_pairs(d, names.known_frame(ws.spark)))
    return f.where(F.col("distance") <= 2).select("name", "known", F.col("distance").cast("int").alias("distance"))


@query("name_similarity", lambda: with_fixtures(["pkg_names"], o_names(), """
SELECT name, known, separator, swap, extra, missing FROM feat WHERE separator OR swap OR extra OR missing"""))
def q_name_similarity(ws):
    d = pkg_names(ws).select("name").distinct()
    _, base = names.split_name(F.col("name"))
    d = d.where(~(F.col("name").isin(POPULAR_PACKAGES) | base.isin(POPULAR_PACKAGES)))
    f = names.pair_features(names.candidate_pairs(d, names.known_frame(ws.spark)))
    return (f.where(F.col("separator") | F.col("swap") | F.col("extra") | F.col("missing"))
            .select("name", "known", "separator", "swap", "extra", "missing"))


# ------------------------------------------------------------------ lockfiles

def lock(ws):
    return ws.table("lock_packages")


def diff(ws):
    return lockdiff.lock_diff(lock(ws))


def flags(ws):
    return lockdiff.lock_flags(diff(ws), ws.table("lock_edges"))


def o_diff():
    return [("ld", """
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.name, n.name) AS name,
       o.version AS old_version, n.version AS new_version,
       o.has_install_script AS old_has_install_script, n.has_install_script AS new_has_install_script,
       n.has_bin AS new_has_bin,
       CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed'
            WHEN o.version IS DISTINCT FROM n.version THEN 'changed' END AS type
FROM (SELECT * FROM lock_packages WHERE snapshot = 'old') o
FULL OUTER JOIN (SELECT * FROM lock_packages WHERE snapshot = 'new') n
  ON o.project_id = n.project_id AND o.name = n.name"""),
            ("d", "SELECT * FROM ld WHERE type IS NOT NULL"),
            ("sv", r"""
SELECT *, CASE WHEN regexp_matches(old_version, '^(\d+)\.(\d+)\.(\d+)') AND regexp_matches(new_version, '^(\d+)\.(\d+)\.(\d+)')
          THEN TRUE ELSE FALSE END AS ok,
       CAST(regexp_extract(old_version, '^(\d+)\.(\d+)\.(\d+)', 1) AS BIGINT) AS o1,
       CAST(regexp_extract(old_version, '^(\d+)\.(\d+)\.(\d+)', 2) AS BIGINT) AS o2,
       CAST(regexp_extract(old_version, '^(\d+)\.(\d+)\.(\d+)', 3) AS BIGINT) AS o3,
       CAST(regexp_extract(new_version, '^(\d+)\.(\d+)\.(\d+)', 1) AS BIGINT) AS n1,
       CAST(regexp_extract(new_version, '^(\d+)\.(\d+)\.(\d+)', 2) AS BIGINT) AS n2,
       CAST(regexp_extract(new_version, '^(\d+)\.(\d+)\.(\d+)', 3) AS BIGINT) AS n3
FROM d WHERE type = 'changed'"""),
            ("svc", """
SELECT *, ok AND n1 > o1 AS major_bump,
       ok AND (n1 < o1 OR (n1 = o1 AND n2 < o2) OR (n1 = o1 AND n2 = o2 AND n3 < o3)) AS downgrade
FROM sv""")]


def o_flags():
    native = ", ".join(sql_str(x) for x in lockdiff.NATIVE_PACKAGES)
    net = ", ".join(sql_str(x) for x in lockdiff.NETWORK_PACKAGES)
    return o_diff() + [("fl", f"""
SELECT project_id, name, 'new-install-script' AS flag, 'New package "' || name || '" has install scripts' AS message
FROM d WHERE type = 'added' AND new_has_install_script
UNION ALL SELECT project_id, name, 'new-native-module', 'New package "' || name || '" is a native module'
FROM d WHERE type = 'added' AND name IN ({native})
UNION ALL SELECT project_id, name, 'new-network-dep', 'New package "' || name || '" has network capabilities'
FROM d WHERE type = 'added' AND name IN ({net})
UNION ALL SELECT project_id, name, 'new-bin', 'New package "' || name || '" installs binaries'
FROM d WHERE type = 'added' AND new_has_bin
UNION ALL SELECT project_id, name, 'major-bump', '"' || name || '" major version bump: ' || old_version || ' -> ' || new_version
FROM svc WHERE major_bump
UNION ALL SELECT project_id, name, 'version-downgrade', '"' || name || '" version downgrade: ' || old_version || ' -> ' || new_version
FROM svc WHERE downgrade
UNION ALL SELECT project_id, name, 'new-install-script', '"' || name || '" added install scripts in ' || new_version
FROM svc WHERE NOT coalesce(old_has_install_script, FALSE) AND new_has_install_script
UNION ALL SELECT c.project_id, c.name, 'new-dependency', '"' || c.name || '" added new dependency "' || e.dep || '"'
FROM svc c JOIN (SELECT project_id, name, dep FROM lock_edges WHERE snapshot = 'new'
                 EXCEPT SELECT project_id, name, dep FROM lock_edges WHERE snapshot = 'old') e
  ON c.project_id = e.project_id AND c.name = e.name""")]


@query("lock_diff", lambda: with_fixtures(["lock_packages"], o_diff(),
                                          "SELECT project_id, name, type, old_version, new_version FROM d"))
def q_lock_diff(ws):
    return diff(ws).select("project_id", "name", "type", "old_version", "new_version")


@query("lock_delta_lists", lambda: with_fixtures(["lock_packages"], o_diff(), """
SELECT project_id, type, CAST(row_number() OVER (PARTITION BY project_id, type ORDER BY name) AS BIGINT) AS rank, name FROM d"""))
def q_lock_delta_lists(ws):
    return lockdiff.delta_lists(diff(ws)).select("project_id", "type", "rank", "name")


@query("semver_changes", lambda: with_fixtures(["lock_packages"], o_diff(), """
SELECT project_id, name, old_version, new_version, coalesce(major_bump, FALSE) AS major_bump,
       coalesce(downgrade, FALSE) AS downgrade FROM svc"""))
def q_semver_changes(ws):
    return lockdiff.semver_changes(diff(ws)).select("project_id", "name", "old_version", "new_version",
                                                    "major_bump", "downgrade")


@query("lock_flags", lambda: with_fixtures(["lock_packages", "lock_edges"], o_flags(), "SELECT * FROM fl"))
def q_lock_flags(ws):
    return flags(ws)


@query("lock_diff_summary", lambda: with_fixtures(["lock_packages", "lock_edges"], o_flags() + [
    ("sz", """SELECT project_id, CAST(count_if(snapshot = 'old') AS BIGINT) AS old_count,
                     CAST(count_if(snapshot = 'new') AS BIGINT) AS new_count FROM lock_packages GROUP BY project_id"""),
    ("dc", """SELECT project_id, CAST(count_if(type = 'added') AS BIGINT) AS added,
                     CAST(count_if(type = 'removed') AS BIGINT) AS removed,
                     CAST(count_if(type = 'changed') AS BIGINT) AS changed FROM d GROUP BY project_id"""),
    ("fc", "SELECT project_id, CAST(count(*) AS BIGINT) AS flags FROM fl GROUP BY project_id"),
    ("s0", """SELECT sz.project_id, old_count, new_count, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
                     coalesce(changed, 0) AS changed, coalesce(flags, 0) AS flags
              FROM sz LEFT JOIN dc USING (project_id) LEFT JOIN fc USING (project_id)"""),
], """
SELECT *, CASE WHEN added + removed + changed + flags = 0 THEN 'No dependency changes'
          ELSE 'Dependency changes: ' || concat_ws(', ',
            CASE WHEN added > 0 THEN CAST(added AS VARCHAR) || ' added' END,
            CASE WHEN removed > 0 THEN CAST(removed AS VARCHAR) || ' removed' END,
            CASE WHEN changed > 0 THEN CAST(changed AS VARCHAR) || ' changed' END,
            CASE WHEN flags > 0 THEN CAST(flags AS VARCHAR) || ' flags' END) END AS summary
FROM s0"""))
def q_lock_diff_summary(ws):
    return lockdiff.diff_summary(lock(ws), diff(ws), flags(ws))


@query("dep_edges", lambda: with_fixtures(["lock_packages", "lock_edges"], [], """
SELECT p.project_id, p.name, p.version, e.dep AS depends_on, coalesce(q.version, '0.0.0') AS depends_on_version
FROM (SELECT * FROM lock_packages WHERE snapshot = 'new') p
JOIN (SELECT * FROM lock_edges WHERE snapshot = 'new') e ON e.project_id = p.project_id AND e.name = p.name
LEFT JOIN (SELECT * FROM lock_packages WHERE snapshot = 'new') q ON q.project_id = p.project_id AND q.name = e.dep"""))
def q_dep_edges(ws):
    return lockdiff.dep_edges(lock(ws), ws.table("lock_edges"))
