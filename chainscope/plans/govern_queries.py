"""Governance queries: policy, lists, permissions, manifest, gate, PR metrics, compliance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chainscope.functions.regex import sql_str
from chainscope.operators import govern as G
from chainscope.operators import license as L
from chainscope.operators import risk
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures
from chainscope.plans.risk_queries import behavior_findings, o_bf
from chainscope.plans.trust_queries import licenses, o_detect, o_normalize

AS_OF = "2024-06-01"
CTX_COLS = ["project_id", "package_name", "version", "license", "risk_score", "has_install_scripts",
            "has_native_modules", "dependency_count", "weekly_downloads", "last_published", "maintainer_count",
            "is_new", "finding_count", "critical_findings", "high_findings"]
KEYS = ["project_id", "package_name"]


# ------------------------------------------------------------------ Spark side

def context(ws):
    c = ws.table("pkg_context").withColumn("license", L.normalize(F.col("license_raw")))
    return G.policy_context(c)


def results(ws):
    return G.policy_results(context(ws))


def evaluation(ws):
    return G.policy_evaluation(results(ws))


def denied(ws):
    lock_new = ws.table("lock_packages").where(F.col("snapshot") == "new").select("project_id", "name", "version")
    chk = G.list_check(lock_new.select("name", "version").distinct(), ws.table("list_entries"), AS_OF)
    return (lock_new.join(chk.where(F.col("list") == "denylist").select("name", "version"), ["name", "version"])
            .select("project_id", "name"))


def reports(ws):
    return context(ws).select("project_id", F.col("package_name").alias("package"), F.col("risk_score").alias("score"),
                              F.col("critical_findings").alias("critical"), F.col("high_findings").alias("high"),
                              F.col("finding_count").alias("findings"))


def facts(ws):
    r = reports(ws).groupBy("project_id").agg(F.count("*").cast("bigint").alias("total_packages"),
                                              F.count(F.when(F.col("score") >= 7, 1)).cast("bigint").alias("high_risk_packages"))
    v = L.violations(licenses(ws)).groupBy("project_id").agg(F.count("*").cast("bigint").alias("license_violations"))
    f = r.join(v, "project_id", "left").fillna(0, ["license_violations"])
    t = F.col("total_packages")
    return (f.withColumn("has_manifest", t % 2 == 0).withColumn("has_lockfile", F.lit(True))
            .withColumn("has_sbom", t % 3 != 0).withColumn("has_policy", t % 5 != 0))


# ------------------------------------------------------------------ oracle side

# FIXED VALUES - the default policy's enabled rules: id, name, text, field, condition, shown value, expectation, action, severity
_DEFAULT = [
    ("max-risk-score", "Maximum Risk Score", "Block packages with risk score above threshold", "riskScore", "risk_score <= 7", "num:risk_score", "lte 7", "block", "critical"),
    ("no-install-scripts", "No Install Scripts", "Warn on packages with preinstall/postinstall scripts", "hasInstallScripts", "NOT has_install_scripts", "bool:has_install_scripts", "eq false", "warn", "medium"),
    ("no-critical-findings", "No Critical Findings", "Block packages with critical security findings", "criticalFindings", "critical_findings = 0", "num:critical_findings", "eq 0", "block", "critical"),
    ("known-license", "Known License Required", "Warn on packages without a recognized license", "license", "license <> 'UNKNOWN'", "str:license", 'neq "UNKNOWN"', "warn", "medium"),
    ("max-findings", "Maximum Findings", "Warn when package has more than 20 findings", "findingCount", "finding_count <= 20", "num:finding_count", "lte 20", "warn", "medium"),
]

# one rule or more for each operator, a field that there is none of, a pattern that is none, types that do not fit;
# (id, field, operator, value) and what they mean in SQL (condition, shown value)
OPERATOR_RULES = [
    (("gt", "dependencyCount", "gt", 2), "dependency_count > 2", "num:dependency_count"),
    (("gt-text", "dependencyCount", "gt", "2"), "dependency_count > 2", "num:dependency_count"),
    (("gt-nan", "dependencyCount", "gt", "two"), "FALSE", "num:dependency_count"),
    (("gte", "riskScore", "gte", 5.5), "risk_score >= 5.5", "num:risk_score"),
    (("lt", "weeklyDownloads", "lt", 50000), "weekly_downloads < 50000", "num:weekly_downloads"),
    (("lt-type", "license", "lt", 3), "FALSE", "str:license"),
    (("lte", "maintainerCount", "lte", True), "maintainer_count <= 1", "num:maintainer_count"),
    (("eq", "isNew", "eq", True), "is_new", "bool:is_new"),
    (("eq-type", "highFindings", "eq", "0"), "FALSE", "num:high_findings"),
    (("neq", "license", "neq", "MIT"), "license <> 'MIT'", "str:license"),
    (("neq-type", "hasNativeModules", "neq", "true"), "TRUE", "bool:has_native_modules"),
    (("in", "license", "in", ["MIT", "ISC", "Apache-2.0"]), "license IN ('MIT', 'ISC', 'Apache-2.0')", "str:license"),
    (("in-numbers", "highFindings", "in", [0, "1", 2.0]), "high_findings IN (0, 2)", "num:high_findings"),
    (("in-no-list", "license", "in", "MIT"), "FALSE", "str:license"),
    (("not-in", "license", "not-in", ["MIT", 3]), "license <> 'MIT'", "str:license"),
    (("not-in-no-list", "license", "not-in", "MIT"), "FALSE", "str:license"),
    (("contains", "packageName", "contains", "1"), "contains(package_name, '1')", "str:package_name"),
    (("contains-number", "version", "contains", 1.0), "contains(version, '1')", "str:version"),
    (("contains-type", "riskScore", "contains", "1"), "FALSE", "num:risk_score"),
    (("matches", "packageName", "matches", "^[a-z]+-\\d+$|\\bacme\\b"), "regexp_matches(package_name, '^[a-z]+-[0-9]+$|\\bacme\\b')", "str:package_name"),
    (("matches-bad", "packageName", "matches", "([a-z"), "FALSE", "str:package_name"),
    (("matches-type", "findingCount", "matches", "."), "FALSE", "num:finding_count"),
    (("no-field", "nothing", "eq", "x"), "FALSE", "null"),
    (("no-field-neq", "nothing", "neq", "x"), "TRUE", "null"),
    (("no-field-null", "nothing", "eq", None), "TRUE", "null"),
    (("no-operator", "license", "like", "MIT"), "FALSE", "str:license"),
]


def operator_policy(spark):
    return G.policy_frame(spark, [(i, f"Rule {i}", f"Checks {i}", field, op, value, "warn" if len(op) % 2 else "block", "low", True)
                                  for (i, field, op, value), _, _ in OPERATOR_RULES] + [("off", "Off", "Never", "license", "eq", "x", "block", "low", False)])


def _o_shown(shown):
    kind, _, col = shown.partition(":")
    return {"num": Q.js_num(f"CAST({col} AS DOUBLE)"), "str": f"CAST(to_json({col}) AS VARCHAR)" if col else "", "bool": f"CASE WHEN {col} THEN 'true' ELSE 'false' END", "null": "'null'"}[kind]


def _o_rule(rid, name, text, field, condition, shown, expectation, action, severity):
    return f"""SELECT project_id, package_name, {sql_str(rid)} AS rule_id, {sql_str(name)} AS rule_name, {condition} AS passed,
       {sql_str(action)} AS action, {sql_str(severity)} AS severity, CASE WHEN {condition} THEN {sql_str(name + ': passed')}
       ELSE {sql_str(f'{name}: {text} ({field} = ')} || {_o_shown(shown)} || {sql_str(f', expected {expectation})')} END AS message FROM ctx"""


def _o_operators():
    import json
    def text(v):
        return str(int(v)) if isinstance(v, float) and v == int(v) else json.dumps(v, separators=(",", ":"))
    def expected(v):
        return "[" + ",".join(text(x) for x in v) + "]" if isinstance(v, list) else text(v)
    return "\nUNION ALL\n".join(_o_rule(i, f"Rule {i}", f"Checks {i}", field, cond, shown, f"{op} {expected(value)}", "warn" if len(op) % 2 else "block", "low")
                                 for (i, field, op, value), cond, shown in OPERATOR_RULES)


def o_policy():
    return [
        ("ctx", f"SELECT * EXCLUDE (license_raw), {o_normalize('license_raw')} AS license FROM pkg_context"),
        ("pres", "\nUNION ALL\n".join(_o_rule(*r) for r in _DEFAULT)),
        ("peval", """
SELECT project_id, package_name, coalesce(bool_or(NOT passed AND action = 'block'), FALSE) AS blocked,
       CAST(count_if(NOT passed AND action = 'warn') AS BIGINT) AS warnings,
       CAST(count_if(passed) AS BIGINT) AS passed, CAST(count_if(NOT passed) AS BIGINT) AS failed
FROM pres GROUP BY project_id, package_name"""),
    ]


def o_list_check(checks):
    return [("lc0", f"""
SELECT c.name, c.version, e.list, e.reason, e.seq
FROM {checks} c LEFT JOIN list_entries e ON e.name = c.name
  AND (e.expires_at IS NULL OR e.expires_at >= '{AS_OF}')
  AND (e.version IS NULL OR c.version IS NULL OR e.version = c.version)"""),
            ("lc", """
SELECT name, version, coalesce(list, 'unlisted') AS l, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY CASE WHEN list = 'deny' THEN 0 ELSE 1 END, seq) AS rn
  FROM lc0) WHERE rn = 1"""),
            ("lcr", """
SELECT name, version, l <> 'deny' AS allowed,
       CASE l WHEN 'deny' THEN 'denylist' WHEN 'allow' THEN 'allowlist' ELSE 'unlisted' END AS list,
       CASE l WHEN 'deny' THEN '"' || name || '" is on the deny list: ' || reason
              WHEN 'allow' THEN '"' || name || '" is on the allow list: ' || reason
              ELSE '"' || name || '" is not on any list (allowed by default)' END AS message
FROM lc""")]


GOV_FIX = ["pkg_context", "list_entries", "lock_packages"]


# ------------------------------------------------------------------ policy queries

@query("policy_context", lambda: with_fixtures(["pkg_context"], o_policy()[:1], f"SELECT {', '.join(CTX_COLS)} FROM ctx"))
def q_policy_context(ws):
    return context(ws).select(*CTX_COLS)


@query("policy_results", lambda: with_fixtures(["pkg_context"], o_policy(), "SELECT * FROM pres"))
def q_policy_results(ws):
    return results(ws)


@query("policy_operators", lambda: with_fixtures(["pkg_context"], [*o_policy()[:1], ("ops", _o_operators())], "SELECT * FROM ops"))
def q_policy_operators(ws):
    """a rule table with all ten operators, against every package."""
    return G.policy_results(context(ws), operator_policy(ws.spark))


@query("policy_evaluation", lambda: with_fixtures(["pkg_context"], o_policy(), "SELECT * FROM peval"))
def q_policy_evaluation(ws):
    return evaluation(ws)


# ------------------------------------------------------------------ lists

@query("list_check", lambda: with_fixtures(["list_checks", "list_entries"], o_list_check("list_checks"),
                                           "SELECT * FROM lcr"))
def q_list_check(ws):
    return G.list_check(ws.table("list_checks"), ws.table("list_entries"), AS_OF)


@query("list_stats", lambda: with_fixtures(["list_entries"], [], f"""
SELECT CAST(count_if(list = 'allow') AS BIGINT) AS allowlist_count, CAST(count_if(list = 'deny') AS BIGINT) AS denylist_count,
       CAST(count_if(expires_at < '{AS_OF}') AS BIGINT) AS expired_count FROM list_entries"""))
def q_list_stats(ws):
    return G.list_stats(ws.table("list_entries"), AS_OF)


def _o_mutations():
    return [
        ("chs", """
SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rdesc FROM list_changes"""),
        ("lastop", "SELECT name, op AS last_op FROM chs WHERE rdesc = 1"),
        ("brk", """
SELECT l.name, l.last_op, max(CASE WHEN c.op <> l.last_op THEN c.rdesc END) AS dummy,
       min(CASE WHEN c.op <> l.last_op THEN c.rdesc END) AS brk_r
FROM lastop l JOIN chs c ON c.name = l.name GROUP BY l.name, l.last_op"""),
        ("run", """
SELECT b.name, b.last_op, b.brk_r, c.version, c.reason, c.event_id FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.name ORDER BY c.ts, c.event_id) AS rr
  FROM chs c JOIN brk b ON b.name = c.name
  WHERE c.op = b.last_op AND (b.brk_r IS NULL OR c.rdesc < b.brk_r)) c
JOIN brk b ON b.name = c.name WHERE c.rr = 1"""),
        ("mut", """
SELECT list, name, version, reason, CAST(seq AS BIGINT) AS source_id FROM list_entries
WHERE name NOT IN (SELECT name FROM lastop)
UNION ALL
SELECT e.list, e.name, e.version, e.reason, CAST(e.seq AS BIGINT) FROM list_entries e JOIN run r ON r.name = e.name
WHERE r.brk_r IS NULL AND e.list = r.last_op
UNION ALL
SELECT r.last_op, r.name, r.version, r.reason, CAST(r.event_id AS BIGINT) FROM run r
WHERE r.last_op <> 'remove'
  AND (r.brk_r IS NOT NULL OR NOT EXISTS (SELECT 1 FROM list_entries e WHERE e.name = r.name AND e.list = r.last_op))"""),
    ]


@query("list_mutations", lambda: with_fixtures(["list_entries", "list_changes"], _o_mutations(), "SELECT * FROM mut"))
def q_list_mutations(ws):
    return G.list_mutations(ws.table("list_entries"), ws.table("list_changes"))


# ------------------------------------------------------------------ permissions

def _o_access():
    def lst(c):
        return f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, ',') END"
    net_ok = ("list_bool_or(list_transform(net_l, lambda g: g = '*' OR regexp_matches(target, "
              "'^' || replace(replace(g, '.', '\\.'), '*', '.*') || '$', 'i')))")

    def real(c):
        # '/' + the parts that neither '..' nor '.' removes, one part after the other
        parts = f"list_prepend('', list_filter(string_split({c}, '/'), lambda x: x NOT IN ('', '.')))"
        path = (f"list_reduce({parts}, lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]+$', '') "
                "ELSE a || '/' || x END)")
        return f"coalesce(nullif({path}, ''), '/')"

    fs_ok = f"list_bool_or(list_transform(fs_l, lambda p: starts_with({real('target')}, {real('p')})))"
    return [
        ("pm", f"SELECT *, {lst('net')} AS net_l, {lst('fs')} AS fs_l, {lst('env')} AS env_l FROM permissions"),
        ("aj", f"""
SELECT r.project_id, r.package_name, r.event_id, r.resource, r.target, p.name IS NOT NULL AS has,
       p.net_blocked, p.net_l, p.fs_blocked, p.fs_l, p.native, p.exec, p.env_mode, p.env_l,
       coalesce({net_ok}, FALSE) AS net_ok, coalesce({fs_ok}, FALSE) AS fs_ok,
       coalesce(list_contains(p.env_l, r.target), FALSE) AS env_ok
FROM access_requests r LEFT JOIN pm p ON p.project_id = r.project_id AND p.name = r.package_name"""),
        ("ar", """
SELECT *, CASE WHEN NOT has THEN 'no-manifest-entry'
  WHEN resource = 'net' THEN CASE WHEN net_blocked THEN 'net-blocked' WHEN target IS NULL THEN 'net-general'
                                  WHEN net_ok THEN 'net-allowed' ELSE 'net-denied' END
  WHEN resource = 'fs' THEN CASE WHEN fs_blocked THEN 'fs-blocked' WHEN target IS NULL THEN 'fs-general'
                                 WHEN fs_ok THEN 'fs-allowed' ELSE 'fs-denied' END
  WHEN resource = 'native' THEN CASE WHEN native THEN 'native-allowed' ELSE 'native-denied' END
  WHEN resource = 'exec' THEN CASE WHEN exec THEN 'exec-allowed' ELSE 'exec-denied' END
  WHEN resource = 'env' THEN CASE WHEN env_mode = 'blocked' THEN 'env-blocked' WHEN env_mode = 'all' THEN 'env-allowed-all'
                                  WHEN target IS NULL THEN 'env-general' WHEN env_ok THEN 'env-allowed' ELSE 'env-denied' END
  ELSE 'unknown-resource' END AS rule FROM aj"""),
        ("acc", """
SELECT project_id, package_name, event_id, resource, target,
  coalesce(CASE WHEN NOT has THEN FALSE
    WHEN resource = 'net' THEN CASE WHEN net_blocked THEN FALSE WHEN target IS NULL THEN len(net_l) > 0 ELSE net_ok END
    WHEN resource = 'fs' THEN CASE WHEN fs_blocked THEN FALSE WHEN target IS NULL THEN len(fs_l) > 0 ELSE fs_ok END
    WHEN resource = 'native' THEN native WHEN resource = 'exec' THEN exec
    WHEN resource = 'env' THEN CASE WHEN env_mode = 'blocked' THEN FALSE WHEN env_mode = 'all' THEN TRUE
                                    WHEN target IS NULL THEN TRUE ELSE env_ok END
    ELSE FALSE END, FALSE) AS allowed, rule,
  CASE rule
    WHEN 'no-manifest-entry' THEN 'Package "' || package_name || '" has no entry in the permission manifest'
    WHEN 'net-blocked' THEN 'Network access is blocked for "' || package_name || '"'
    WHEN 'net-general' THEN 'Network allowed to: ' || array_to_string(net_l, ', ')
    WHEN 'net-allowed' THEN '"' || target || '" matches allowed network pattern'
    WHEN 'net-denied' THEN '"' || target || '" does not match any allowed network pattern for "' || package_name || '"'
    WHEN 'fs-blocked' THEN 'Filesystem access is blocked for "' || package_name || '"'
    WHEN 'fs-general' THEN 'FS allowed in: ' || array_to_string(fs_l, ', ')
    WHEN 'fs-allowed' THEN '"' || target || '" is within allowed filesystem paths'
    WHEN 'fs-denied' THEN '"' || target || '" is not within any allowed filesystem path for "' || package_name || '"'
    WHEN 'native-allowed' THEN 'Native modules allowed for "' || package_name || '"'
    WHEN 'native-denied' THEN 'Native modules blocked for "' || package_name || '"'
    WHEN 'exec-allowed' THEN 'Process execution allowed for "' || package_name || '"'
    WHEN 'exec-denied' THEN 'Process execution blocked for "' || package_name || '"'
    WHEN 'env-blocked' THEN 'Environment variable access blocked for "' || package_name || '"'
    WHEN 'env-allowed-all' THEN 'All environment variables allowed for "' || package_name || '"'
    WHEN 'env-general' THEN 'Env access allowed for: ' || array_to_string(env_l, ', ')
    WHEN 'env-allowed' THEN 'Env var "' || target || '" is allowed for "' || package_name || '"'
    WHEN 'env-denied' THEN 'Env var "' || target || '" is not allowed for "' || package_name || '"'
    ELSE 'Unknown resource type: ' || resource END AS details
FROM ar"""),
    ]


@query("access_check", lambda: with_fixtures(["permissions", "access_requests"], _o_access(), "SELECT * FROM acc"))
def q_access_check(ws):
    a = G.access_check(ws.table("access_requests"), ws.table("permissions"))
    return a.select("project_id", "package_name", "event_id", "resource", "target", "allowed", "rule", "details")


@query("manifest_generate", lambda: with_fixtures(["src_files"], o_bf(), """
SELECT p.project_id, p.package,
       CASE WHEN bool_or(category = 'network') THEN '[]' ELSE 'false' END AS net,
       CASE WHEN bool_or(category = 'filesystem') THEN '[]' ELSE 'false' END AS fs,
       CASE WHEN bool_or(category = 'process') THEN 'false' END AS exec,
       CASE WHEN bool_or(category = 'environment') THEN '[]' END AS env
FROM (SELECT DISTINCT project_id, package FROM src_files WHERE package IS NOT NULL) p
LEFT JOIN bf ON bf.project_id = p.project_id AND bf.package = p.package
GROUP BY p.project_id, p.package"""))
def q_manifest_generate(ws):
    return G.manifest_generate(risk.category_counts(behavior_findings(ws), ["project_id", "package"]),
                               ws.table("src_files").where("package IS NOT NULL"))


# ------------------------------------------------------------------ gate, PR, compliance

def o_gate_inputs():
    return (o_policy() + o_detect() + o_list_check("(SELECT DISTINCT name, version FROM lock_packages WHERE snapshot = 'new')")
            + [("rep", """SELECT project_id, package_name AS package, risk_score AS score, critical_findings AS critical,
                                 high_findings AS high, finding_count AS findings FROM ctx"""),
               ("den", """SELECT l.project_id, l.name FROM lock_packages l JOIN lcr c ON c.name = l.name AND c.version = l.version
                          WHERE l.snapshot = 'new' AND c.list = 'denylist'""")])


def _o_gate():
    g = G.DEFAULT_GATE
    ms = "printf('%.1f', max_score)"
    return o_gate_inputs() + [
        ("g0", """
SELECT project_id, greatest(max(score), 0.0) AS max_score, min({'s': -score, 'p': package}).p AS top_pkg,
       CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high FROM rep GROUP BY project_id"""),
        ("g1", """
SELECT g0.*, CASE WHEN max_score > 0 THEN top_pkg ELSE '' END AS max_pkg,
       coalesce(v.n, 0) AS lic, coalesce(p.b, FALSE) AS pb, coalesce(d.n, 0) AS den, d.names AS den_names
FROM g0 LEFT JOIN (SELECT project_id, count(*) AS n FROM viol GROUP BY project_id) v USING (project_id)
LEFT JOIN (SELECT project_id, bool_or(blocked) AS b FROM peval GROUP BY project_id) p USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(name)))[1:10], ', ')
             || CASE WHEN count(DISTINCT name) > 10 THEN ', ...' ELSE '' END AS names
           FROM den GROUP BY project_id) d USING (project_id)"""),
        ("gate", f"""
SELECT project_id, 'Max Risk Score' AS check, max_score <= {g['max_risk_score']} AS passed,
       CASE WHEN max_score <= {g['max_risk_score']} THEN 'Highest risk: ' || {ms} || '/10 (threshold: {g['max_risk_score']})'
            ELSE '"' || max_pkg || '" has risk score ' || {ms} || '/10 (max allowed: {g['max_risk_score']})' END AS message,
       'critical' AS severity FROM g1
UNION ALL SELECT project_id, 'Critical Findings', critical <= {g['max_critical']},
       CASE WHEN critical <= {g['max_critical']} THEN CAST(critical AS VARCHAR) || ' critical findings (max: {g['max_critical']})'
            ELSE CAST(critical AS VARCHAR) || ' critical findings exceed limit of {g['max_critical']}' END, 'critical' FROM g1
UNION ALL SELECT project_id, 'High Findings', high <= {g['max_high']},
       CASE WHEN high <= {g['max_high']} THEN CAST(high AS VARCHAR) || ' high findings (max: {g['max_high']})'
            ELSE CAST(high AS VARCHAR) || ' high findings exceed limit of {g['max_high']}' END, 'high' FROM g1
UNION ALL SELECT project_id, 'License Compliance', lic = 0,
       CASE WHEN lic = 0 THEN 'No license violations' ELSE CAST(lic AS VARCHAR) || ' license violation(s)' END, 'high' FROM g1
UNION ALL SELECT project_id, 'Policy Compliance', NOT pb,
       CASE WHEN pb THEN 'Policy evaluation blocked one or more packages' ELSE 'All packages pass policy' END, 'critical' FROM g1
UNION ALL SELECT project_id, 'Denied Packages', FALSE, CAST(den AS VARCHAR) || ' denied package(s): ' || den_names,
       'critical' FROM g1 WHERE den > 0"""),
    ]


GATE_FIX = ["pkg_context", "list_entries", "lock_packages", "package_meta", "license_docs", "project_manifest"]


@query("gate_checks", lambda: with_fixtures(GATE_FIX, _o_gate(), "SELECT * FROM gate"))
def q_gate_checks(ws):
    return G.gate_checks(reports(ws), L.violations(licenses(ws)), evaluation(ws), denied(ws))


@query("pr_metrics", lambda: with_fixtures(GATE_FIX, o_gate_inputs(), """
SELECT r.project_id, r.packages, r.high_risk, r.medium_risk, r.findings,
       coalesce(v.n, 0) AS license_violations, coalesce(p.n, 0) AS policy_failures, printf('%.1f', r.avg) AS average_score,
       CASE WHEN r.high_risk > 0 OR coalesce(v.n, 0) > 0 THEN 'failure' WHEN r.medium_risk > 0 THEN 'warning'
            ELSE 'success' END AS status
FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS packages, CAST(count_if(score >= 7) AS BIGINT) AS high_risk,
             CAST(count_if(score >= 4 AND score < 7) AS BIGINT) AS medium_risk, CAST(sum(findings) AS BIGINT) AS findings,
             CAST(sum(CAST(score AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg
      FROM rep GROUP BY project_id) r
LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS n FROM viol GROUP BY project_id) v USING (project_id)
LEFT JOIN (SELECT project_id, CAST(count_if(failed > 0) AS BIGINT) AS n FROM peval GROUP BY project_id) p USING (project_id)"""))
def q_pr_metrics(ws):
    return G.pr_metrics(reports(ws), L.violations(licenses(ws)), evaluation(ws))


def _o_facts():
    return o_gate_inputs() + [("facts", """
SELECT r.project_id, r.total_packages, r.high_risk_packages, coalesce(v.n, 0) AS license_violations,
       r.total_packages % 2 = 0 AS has_manifest, TRUE AS has_lockfile, r.total_packages % 3 <> 0 AS has_sbom,
       r.total_packages % 5 <> 0 AS has_policy
FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS total_packages, CAST(count_if(score >= 7) AS BIGINT) AS high_risk_packages
      FROM rep GROUP BY project_id) r
LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS n FROM viol GROUP BY project_id) v USING (project_id)""")]


def _o_controls():
    st = {
        "met": "'met'", "manifest": "CASE WHEN has_manifest THEN 'met' ELSE 'partial' END",
        "lockfile": "CASE WHEN has_lockfile THEN 'met' ELSE 'partial' END",
        "policy": "CASE WHEN has_policy THEN 'met' ELSE 'partial' END",
        "sbom": "CASE WHEN has_sbom THEN 'met' ELSE 'partial' END",
        "sbom_strict": "CASE WHEN has_sbom THEN 'met' ELSE 'not-met' END",
        "high_risk": "CASE WHEN high_risk_packages = 0 THEN 'met' WHEN high_risk_packages <= 2 THEN 'partial' ELSE 'not-met' END",
        "license": "CASE WHEN license_violations = 0 THEN 'met' ELSE 'not-met' END",
        "manifest_and_policy": "CASE WHEN has_manifest AND has_policy THEN 'met' ELSE 'partial' END",
    }
    parts = [f"SELECT project_id, {sql_str(fw)} AS framework, {sql_str(cid)} AS control_id, {sql_str(name)} AS control_name, "
             f"{st[rule]} AS status FROM facts" for fw, cid, name, rule in G.CONTROLS]
    return _o_facts() + [("ctrl", "\nUNION ALL\n".join(parts))]


@query("compliance_controls", lambda: with_fixtures(GATE_FIX, _o_controls(), "SELECT * FROM ctrl"))
def q_compliance_controls(ws):
    return G.compliance_controls(facts(ws))


def _o_notes():
    parts = []
    for fw, cid, _, rule in G.CONTROLS:
        for n, (kind, cond, text) in enumerate(G.CONTROL_NOTES[rule], 1):
            told = " || ".join(t if k % 2 else sql_str(t) for k, t in enumerate(re.split(r"[{}]", text)))
            parts.append(f"SELECT project_id, '{fw}' AS framework, '{cid}' AS control_id, {sql_str(G.CONTROL_GOALS[cid])} AS goal, '{kind}' AS kind, "
                         f"CAST({n} AS INTEGER) AS n, {told} AS text FROM facts WHERE {cond}")
    return _o_facts() + [("notes", "\nUNION ALL\n".join(parts))]


@query("compliance_notes", lambda: with_fixtures(GATE_FIX, _o_notes(), "SELECT * FROM notes"))
def q_compliance_notes(ws):
    """What each control's status rests on."""
    return G.compliance_notes(facts(ws))


@query("denied_packages", lambda: with_fixtures(GATE_FIX, o_gate_inputs(), "SELECT DISTINCT project_id, name FROM den"))
def q_denied_packages(ws):
    """Every denied package of a project, as rows."""
    return denied(ws).distinct()


@query("compliance_summary", lambda: with_fixtures(GATE_FIX, _o_controls(), f"""
SELECT project_id, framework, CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'met') AS BIGINT) AS met,
       CAST(count_if(status = 'partial') AS BIGINT) AS partial, CAST(count_if(status = 'not-met') AS BIGINT) AS not_met,
       CAST(count_if(status = 'not-applicable') AS BIGINT) AS not_applicable,
       CASE framework {' '.join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in G.FRAMEWORK_NAMES.items())} END AS framework_name,
       {Q.js_round("(count_if(status = 'met') + count_if(status = 'partial') * 0.5) / (count(*) - count_if(status = 'not-applicable')) * 100.0")} AS score
FROM ctrl GROUP BY project_id, framework"""))
def q_compliance_summary(ws):
    return G.compliance_summary(G.compliance_controls(facts(ws)))


@query("manifest_coverage", lambda: with_fixtures(["observations", "permissions"], [], """
SELECT i.project_id, i.name, p.name IS NOT NULL AS covered,
       CASE WHEN p.name IS NOT NULL THEN concat_ws(', ',
         CASE WHEN p.net_blocked THEN 'net:blocked'
              ELSE 'net:' || CAST(CASE WHEN p.net = '' THEN 0 ELSE len(string_split(p.net, ',')) END AS VARCHAR) || ' rules' END,
         CASE WHEN p.fs_blocked THEN 'fs:blocked'
              ELSE 'fs:' || CAST(CASE WHEN p.fs = '' THEN 0 ELSE len(string_split(p.fs, ',')) END AS VARCHAR) || ' paths' END,
         CASE WHEN p.native THEN 'native:yes' END, CASE WHEN p.exec THEN 'exec:yes' END) END AS restrictions
FROM (SELECT DISTINCT project_id, name FROM observations) i
LEFT JOIN permissions p ON p.project_id = i.project_id AND p.name = i.name"""))
def q_manifest_coverage(ws):
    return G.manifest_coverage(ws.table("observations"), ws.table("permissions"))
