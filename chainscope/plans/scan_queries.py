"""Scan queries (S1-S4, P1-P10, A1-A3, J17) and their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainscope.catalog.advice import ADVICE
from chainscope.functions.regex import sql_str
from chainscope.functions.sizing import spread
from chainscope.operators import report, scan
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures
from chainscope.sources import files as S

FINDING_OUT = ["project_id", "rule_id", "owasp", "owasp_name", "cwe", "severity", "confidence", "file", "line",
               "col", "snippet"]


# ------------------------------------------------------------------ Spark side

def src_files(ws):
    return ws.table("src_files")


def collected(ws):
    """Listed files, spread over the cores once: the scan and the file
    counts read the same exchange."""
    return ws.memo("collected", lambda: spread(S.collect_files(src_files(ws)), ["project_id", "path"]))


def findings(ws, rules=None, dedup=True):
    rules = rules if rules is not None else scan.source_rules()
    return scan.scan_source(collected(ws), rules, keep=("project_id", "path"), dedup=dedup)


# ------------------------------------------------------------------ oracle side

def o_ext(path: str) -> str:
    return f"regexp_extract(regexp_extract({path}, '[^/]*$'), '^.+(\\.[^.]*)$', 1)"


def o_ignored(path: str, patterns: list[str]) -> str:
    conds = []
    for p in patterns:
        if "*" not in p and "." not in p:
            conds.append(f"list_contains(string_split({path}, '/'), {sql_str(p)})")
        if p.startswith("*."):
            conds.append(f"instr({path} || '/', {sql_str(p[1:] + '/')}) > 0")
        conds.append(f"instr({path} || '/', {sql_str(p + '/')}) > 0")
    return "(" + " OR ".join(conds) + ")"


def o_in_dirs(path: str, dirs: list[str]) -> str:
    alt = "|".join(d.replace(".", "\\.") for d in dirs)
    return f"regexp_matches({path}, {sql_str('(^|/)(' + alt + ')/')})"


def o_collect_files_cte(src: str = "src_files") -> list[tuple[str, str]]:
    exts = ", ".join(sql_str(e) for e in S.DEFAULT_EXTENSIONS)
    return [("files_all", f"""
SELECT * FROM {src}
WHERE {o_ext('path')} IN ({exts})
  AND NOT {o_ignored('path', S.DEFAULT_IGNORE)}
  AND NOT {o_in_dirs('path', S.TEST_DIRS)}
  AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), {sql_str(S.TEST_FILE_RE)})"""),
            ("files", "SELECT * FROM files_all")]


def o_rules_cte(rules) -> tuple[str, str]:
    cols = ["rule_idx", "rule_id", "owasp", "owasp_name", "cwe", "severity", "confidence", "message", "pat"]
    rows = [(r["rule_idx"], r["rule_id"], r["owasp"], r["owasp_name"], r["cwe"], r["severity"], r["confidence"],
             r["message"], Q.split_rule_pattern(r["rule_id"], r["re2"])) for r in rules]
    return ("rules", Q.values_cte(cols, rows))


RULE_COLS = ["rule_idx", "rule_id", "owasp", "owasp_name", "cwe", "severity", "confidence"]


def o_findings_ctes(dedup=True, rules=None) -> list[tuple[str, str]]:
    rules = rules if rules is not None else scan.source_rules()
    return (o_collect_files_cte() + [o_rules_cte(rules)]
            + Q.match_ctes("files", "rules", RULE_COLS, ["project_id", "path"], dedup, split_rules=True)
            + [("findings", "SELECT * EXCLUDE (path), path AS file FROM m_out")])


def o_select_findings(src="findings"):
    return f"SELECT {', '.join(FINDING_OUT)} FROM {src}"


# ------------------------------------------------------------------ queries

@query("collect_files", lambda: with_fixtures(["src_files"], o_collect_files_cte(),
                                              "SELECT project_id, path FROM files"))
def q_collect_files(ws):
    return collected(ws).select("project_id", "path")


def _o_package_files():
    exts = ", ".join(sql_str(e) for e in S.PACKAGE_EXTENSIONS)
    return with_fixtures(["src_files"], [], f"""
SELECT project_id, package, path FROM src_files
WHERE {o_ext('path')} IN ({exts}) AND NOT {o_in_dirs('path', S.PACKAGE_SKIP_DIRS)}""")


@query("collect_package_files", _o_package_files)
def q_collect_package_files(ws):
    return S.collect_package_files(src_files(ws)).select("project_id", "package", "path")


@query("ignore_filter", lambda: with_fixtures(["src_files"], [], f"""
SELECT project_id, path, {o_ignored('path', S.DEFAULT_IGNORE)} AS ignored FROM src_files"""))
def q_ignore_filter(ws):
    return src_files(ws).select("project_id", "path", S.ignored(F.col("path"), S.DEFAULT_IGNORE).alias("ignored"))


@query("scan_findings", lambda: with_fixtures(["src_files"], o_findings_ctes(dedup=False), o_select_findings()))
def q_scan_findings(ws):
    return findings(ws, dedup=False).select(*FINDING_OUT)


@query("dedup_findings", lambda: with_fixtures(["src_files"], o_findings_ctes(), o_select_findings()))
def q_dedup_findings(ws):
    return findings(ws).select(*FINDING_OUT)


@query("scan_threshold", lambda: with_fixtures(
    ["src_files"], o_findings_ctes(rules=scan.source_rules("high", "medium")), o_select_findings()))
def q_scan_threshold(ws):
    return findings(ws, rules=scan.source_rules("high", "medium")).select(*FINDING_OUT)


@query("scan_full", lambda: with_fixtures(["src_files"], o_findings_ctes(), o_select_findings()))
def q_scan_full(ws):
    """De-duplicated findings with the catalogue's rules named outright."""
    return findings(ws, rules=scan.source_rules()).select(*FINDING_OUT)


@query("ranked_findings", lambda: with_fixtures(["src_files"], o_findings_ctes(), f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id
         ORDER BY {Q.sev_rank('severity')}, file, line, rule_idx, col) AS BIGINT) AS rank,
       rule_id, severity, file, line, col
FROM findings"""))
def q_ranked_findings(ws):
    return report.ranked_findings(findings(ws)).select("project_id", "rank", "rule_id", "severity", "file", "line",
                                                       "col")


def _o_summary_cte():
    sev = ",\n".join(f"CAST(count_if(f.severity = '{s}') AS BIGINT) AS {s}" for s in report.SEVERITIES)
    conf = ",\n".join(f"CAST(count_if(f.confidence = '{c}') AS BIGINT) AS conf_{c}" for c in report.CONFIDENCES)
    raw = "(coalesce(critical,0) * 10 + coalesce(high,0) * 5 + coalesce(medium,0) * 2 + coalesce(low,0) * 0.5)"
    return f"""
, agg AS (
  SELECT project_id, CAST(count(*) AS BIGINT) AS total_findings,
         CAST(count(DISTINCT file) AS BIGINT) AS files_with_findings,
         {sev}, {conf}
  FROM findings f GROUP BY project_id
), nf AS (SELECT project_id, CAST(count(*) AS BIGINT) AS total_files FROM files GROUP BY project_id)
, summ AS (
SELECT nf.project_id, nf.total_files,
       coalesce(total_findings, 0) AS total_findings, coalesce(files_with_findings, 0) AS files_with_findings,
       {', '.join(f'coalesce({s}, 0) AS {s}' for s in report.SEVERITIES)},
       {', '.join(f'coalesce(conf_{c}, 0) AS conf_{c}' for c in report.CONFIDENCES)},
       CAST(least(100, {Q.js_round('100.0 * (1.0 - exp(-' + raw + ' / 20.0))')}) AS BIGINT) AS risk_score
FROM nf LEFT JOIN agg USING (project_id))"""


def _with_select(ctes, select_tail):
    """Append extra CTEs written as ', name AS (...)' before the select."""
    sql = with_fixtures(["src_files"], ctes, "SELECT 1")
    return sql[: -len("SELECT 1")].rstrip() + select_tail


@query("scan_summary", lambda: _with_select(o_findings_ctes(), _o_summary_cte() + "\nSELECT * FROM summ"))
def q_scan_summary(ws):
    return report.scan_summary(findings(ws), collected(ws))


@query("scan_counts", lambda: _with_select(o_findings_ctes(), "\nUNION ALL\n".join(
    f"SELECT project_id, '{c}' AS grouping, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY project_id, {c}"
    for c in ("severity", "confidence", "owasp", "cwe"))))
def q_scan_counts(ws):
    return report.scan_counts(findings(ws))


def _o_details():
    advice = [(k, *v) for k, v in ADVICE.items()]
    words = "string_split(lower(regexp_replace(rule_id, '^[A-Z0-9]+-', '')), '-')"
    return [*o_findings_ctes(), ("advice", Q.values_cte(["owasp", "description", "fix", "false_positive"], advice)),
            ("tagged", f"SELECT *, list_concat([lower(owasp), 'cwe-' || cwe], {words}) AS t FROM findings")]


@query("finding_details", lambda: with_fixtures(["src_files"], _o_details(), """
SELECT project_id, file, line, f.rule_id, description, fix, false_positive,
       array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags
FROM tagged f JOIN advice USING (owasp)"""))
def q_finding_details(ws):
    return scan.with_details(findings(ws)).select("project_id", "file", "line", "rule_id", "description", "fix", "false_positive", "tags")


@query("source_risk_score", lambda: _with_select(o_findings_ctes(), _o_summary_cte() + """
SELECT project_id, critical, high, medium, low, risk_score FROM summ"""))
def q_source_risk_score(ws):
    return report.scan_summary(findings(ws), collected(ws)).select(
        "project_id", "critical", "high", "medium", "low", "risk_score")


def _o_top_rules():
    return f"""
, counts AS (
  SELECT project_id, rule_id, CAST(count(*) AS BIGINT) AS count,
         min(({Q.sev_rank('severity')}, file, line, rule_idx, col)) AS first
  FROM findings GROUP BY project_id, rule_id
), top AS (
  SELECT * FROM (
    SELECT project_id, rule_id, count,
           CAST(row_number() OVER (PARTITION BY project_id ORDER BY count DESC, first) AS BIGINT) AS rank
    FROM counts) WHERE rank <= 10
)"""


@query("top_rules", lambda: _with_select(o_findings_ctes(), _o_top_rules() + "\nSELECT project_id, rank, rule_id, count FROM top"))
def q_top_rules(ws):
    return report.top_rules(findings(ws)).select("project_id", "rank", "rule_id", "count")


@query("top_issues", lambda: _with_select(o_findings_ctes(), _o_top_rules() + """
SELECT t.project_id, t.rank, t.rule_id, t.count, coalesce(r.severity, 'medium') AS severity
FROM top t LEFT JOIN rules r USING (rule_id)"""))
def q_top_issues(ws):
    rules = scan.rules_frame(ws.spark, scan.source_rules(), ["rule_id", "severity"])
    return report.top_issues(report.top_rules(findings(ws)), rules).select(
        "project_id", "rank", "rule_id", "count", "severity")


@query("project_scan", lambda: _with_select(o_findings_ctes(), _o_summary_cte() + """
SELECT s.project_id, f.severity, CAST(count(*) AS BIGINT) AS findings,
       CAST(count(DISTINCT f.file) AS BIGINT) AS files, s.total_files, s.risk_score
FROM findings f JOIN summ s USING (project_id)
GROUP BY s.project_id, f.severity, s.total_files, s.risk_score"""))
def q_project_scan(ws):
    return project_scan(ws, scan.source_rules())


def project_scan(ws, rules):
    """P10 flagship: files -> scan -> dedup -> per project and severity,
    with the project's risk score.

    One aggregate of the findings per (project, severity); the project
    score is a window over those few rows, so the regex stage runs once.
    """
    files = collected(ws)
    f = scan.scan_source(files, rules, keep=("project_id", "path"))
    per = f.groupBy("project_id", "severity").agg(F.count("*").cast("bigint").alias("findings"),
                                                  F.countDistinct("file").cast("bigint").alias("files"))
    # the project's severity counts come from its (at most five) rows by a
    # window: the findings have a single consumer, so the scan runs once
    w = Window.partitionBy("project_id")
    sev = {s: F.sum(F.when(F.col("severity") == s, F.col("findings")).otherwise(0)).over(w)
           for s in report.SEVERITIES}
    per = per.withColumn("risk_score", report.source_risk(sev["critical"], sev["high"], sev["medium"], sev["low"]))
    nfiles = files.groupBy("project_id").agg(F.count("*").cast("bigint").alias("total_files"))
    return (per.join(nfiles, "project_id")
            .select("project_id", "severity", "findings", "files", "total_files", "risk_score"))


def _o_ignore_files():
    pats = (f"list_filter(list_transform(list(line), lambda l: {Q.js_trim('l')}), "
            f"lambda p: p <> '' AND NOT starts_with(p, '#'))")
    match = ("(NOT contains(p, '*') AND NOT contains(p, '.') AND list_contains(string_split(f.path, '/'), p)) "
             "OR (starts_with(p, '*.') AND instr(f.path || '/', substr(p, 2) || '/') > 0) "
             "OR instr(f.path || '/', p || '/') > 0")
    ctes = o_collect_files_cte()
    ctes = [(n, s.replace("FROM files_all", "FROM files_ig")) if n == "files" else (n, s) for n, s in ctes]
    return ctes[:1] + [
        ("ign", f"SELECT project_id, {pats} AS pats FROM ignore_files GROUP BY project_id"),
        ("files_ig", f"""
SELECT f.* FROM files_all f LEFT JOIN ign USING (project_id)
WHERE NOT coalesce(list_bool_or(list_transform(ign.pats, lambda p: {match})), FALSE)"""),
    ] + ctes[1:]


@query("ignore_file_filter", lambda: with_fixtures(["src_files", "ignore_files"], _o_ignore_files(),
                                                   "SELECT project_id, path FROM files"))
def q_ignore_file_filter(ws):
    """Listing with each project's ignore file on top of the defaults."""
    return S.collect_files(src_files(ws), ignore_files=ws.table("ignore_files")).select("project_id", "path")
