"""Catalogue coverage queries (S18, A6-A9, F11, J16), joined to scan findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainscope.catalog.scan_rules import CRITICAL_CWES, CWE_NAMES, OWASP_NAMES, SCAN_RULES
from chainscope.operators import catalog as C
from chainscope.operators import report
from chainscope.plans import sql as Q
from chainscope.plans.registry import query
from chainscope.plans.scan_queries import _o_summary_cte, _with_select, collected, findings, o_findings_ctes


def o_catalog():
    rules = [(i, r[0], r[1], r[2], r[3], r[4]) for i, r in enumerate(SCAN_RULES)]
    return [
        ("cat_rules", Q.values_cte(["rule_idx", "rule_id", "owasp", "cwe", "severity", "confidence"], rules)),
        ("cats", Q.values_cte(["cat_idx", "owasp", "name"], [(i, k, v) for i, (k, v) in enumerate(OWASP_NAMES.items())])),
        ("cwen", Q.values_cte(["cwe", "cwe_name"], list(CWE_NAMES.items()))),
        ("cov", """
SELECT c.cat_idx, c.owasp, c.name, CAST(count(r.rule_id) AS BIGINT) AS rule_count,
       CAST(count(DISTINCT r.cwe) AS BIGINT) AS cwe_count,
       CAST(count_if(r.severity = 'critical') AS BIGINT) AS critical, CAST(count_if(r.severity = 'high') AS BIGINT) AS high,
       CAST(count_if(r.severity = 'medium') AS BIGINT) AS medium, CAST(count_if(r.severity = 'low') AS BIGINT) AS low
FROM cats c LEFT JOIN cat_rules r ON r.owasp = c.owasp GROUP BY c.cat_idx, c.owasp, c.name"""),
        ("cov2", """
SELECT *, CASE WHEN rule_count >= 8 THEN 'comprehensive' WHEN rule_count >= 5 THEN 'good'
               WHEN rule_count >= 3 THEN 'basic' WHEN rule_count >= 1 THEN 'minimal' ELSE 'none' END AS coverage_level
FROM cov"""),
        ("fcat", "SELECT owasp, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY owasp"),
    ]


def _sql(select_tail):
    ctes = o_findings_ctes() + o_catalog()
    return _with_select(ctes, "\n" + select_tail)


def cov_with_findings(ws):
    f = findings(ws).groupBy("owasp").agg(F.count("*").cast("bigint").alias("findings"))
    return C.coverage(ws.spark).join(f, "owasp", "left").fillna(0, ["findings"])


@query("rule_stats", lambda: _sql("""
SELECT r.rule_id, r.owasp, r.cwe, r.severity, r.confidence, CAST(coalesce(f.n, 0) AS BIGINT) AS findings
FROM cat_rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id) f USING (rule_id)"""))
def q_rule_stats(ws):
    f = findings(ws).groupBy("rule_id").agg(F.count("*").cast("bigint").alias("findings"))
    return (C.rules_table(ws.spark).join(f, "rule_id", "left").fillna(0, ["findings"])
            .select("rule_id", "owasp", "cwe", "severity", "confidence", "findings"))


@query("coverage", lambda: _sql("""
SELECT c.owasp, c.name, rule_count, cwe_count, critical, high, medium, low, coverage_level,
       CAST(coalesce(f.findings, 0) AS BIGINT) AS findings
FROM cov2 c LEFT JOIN fcat f USING (owasp)"""))
def q_coverage(ws):
    return cov_with_findings(ws).select("owasp", "name", "rule_count", "cwe_count", "critical", "high", "medium",
                                        "low", "coverage_level", "findings")


@query("cwe_matrix", lambda: _sql("""
SELECT CAST(row_number() OVER (ORDER BY r.cwe) AS BIGINT) AS rank, r.cwe, coalesce(n.cwe_name, 'CWE-' || CAST(r.cwe AS VARCHAR)) AS name, CAST(count(*) AS BIGINT) AS rule_count,
       array_to_string(list_sort(list_distinct(list(r.owasp))), ',') AS categories,
       CAST(coalesce(max(f.n), 0) AS BIGINT) AS findings
FROM cat_rules r LEFT JOIN cwen n USING (cwe)
LEFT JOIN (SELECT cwe, count(*) AS n FROM findings GROUP BY cwe) f USING (cwe)
GROUP BY r.cwe, n.cwe_name"""))
def q_cwe_matrix(ws):
    f = findings(ws).groupBy("cwe").agg(F.count("*").cast("bigint").alias("findings"))
    return (C.cwe_matrix(ws.spark).join(f, "cwe", "left").fillna(0, ["findings"])
            .withColumn("rank", F.row_number().over(Window.orderBy("cwe")).cast("bigint"))  # a row for each CWE of the catalogue
            .select("rank", "cwe", "name", "rule_count", "categories", "findings"))


def _o_score():
    return """
, sc AS (
  SELECT CAST(floor(avg(CASE coverage_level WHEN 'comprehensive' THEN 100 WHEN 'good' THEN 75 WHEN 'basic' THEN 50
                                       WHEN 'minimal' THEN 25 ELSE 0 END) + 0.5) AS BIGINT) AS overall_score
  FROM cov2 WHERE owasp <> 'EXTRA')"""


@query("coverage_score", lambda: _sql(_o_score() + """
SELECT overall_score, CASE WHEN overall_score >= 80 THEN 'Strong' WHEN overall_score >= 60 THEN 'Moderate'
                           WHEN overall_score >= 40 THEN 'Basic' ELSE 'Weak' END AS overall_level,
       CAST((SELECT count(*) FROM cat_rules) AS BIGINT) AS total_rules,
       CAST((SELECT count(DISTINCT cwe) FROM cat_rules) AS BIGINT) AS total_cwes,
       CAST((SELECT count(*) FROM findings) AS BIGINT) AS total_findings
FROM sc"""))
def q_coverage_score(ws):
    # three one-row results combined by union + aggregate (no join)
    s = C.coverage_score(C.coverage(ws.spark))
    r = C.rules_table(ws.spark).agg(F.count("*").cast("bigint").alias("total_rules"),
                                    F.countDistinct("cwe").cast("bigint").alias("total_cwes"))
    f = findings(ws).agg(F.count("*").cast("bigint").alias("total_findings"))
    u = s.unionByName(r, allowMissingColumns=True).unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in ["overall_score", "overall_level", "total_rules", "total_cwes",
                                               "total_findings"]])


def _o_gaps():
    crit = ", ".join(f"({c})" for c in CRITICAL_CWES)
    return f"""
, gaps AS (
  SELECT owasp, owasp || ' ' || name || ': No rules defined' AS gap FROM cov2
  WHERE owasp <> 'EXTRA' AND coverage_level = 'none'
  UNION ALL
  SELECT owasp, owasp || ' ' || name || ': Only ' || CAST(rule_count AS VARCHAR) || ' rule(s) — minimal coverage'
  FROM cov2 WHERE owasp <> 'EXTRA' AND coverage_level = 'minimal'
  UNION ALL
  SELECT owasp, owasp || ' ' || name || ': Only ' || CAST(cwe_count AS VARCHAR) || ' unique CWE(s) covered'
  FROM cov2 WHERE owasp <> 'EXTRA' AND cwe_count < 2 AND rule_count > 0
  UNION ALL
  SELECT CAST(NULL AS VARCHAR), 'CWE-' || CAST(c.cwe AS VARCHAR) || ' (' || coalesce(n.cwe_name, 'Unknown')
         || '): Not covered by any rule'
  FROM (VALUES {crit}) AS c(cwe) LEFT JOIN cwen n USING (cwe)
  WHERE c.cwe NOT IN (SELECT cwe FROM cat_rules))"""


@query("coverage_gaps", lambda: _sql(_o_gaps() + """
SELECT g.owasp, g.gap, CAST(coalesce(f.findings, 0) AS BIGINT) AS findings
FROM gaps g LEFT JOIN fcat f USING (owasp)"""))
def q_coverage_gaps(ws):
    f = findings(ws).groupBy("owasp").agg(F.count("*").cast("bigint").alias("findings"))
    g = C.gaps(ws.spark, C.coverage(ws.spark))
    return g.join(f, "owasp", "left").fillna(0, ["findings"]).select("owasp", "gap", "findings")


@query("owasp_report", lambda: _sql(_o_summary_cte() + _o_score() + """
, pc AS (SELECT project_id, owasp, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY project_id, owasp)
SELECT s.project_id, c.owasp, c.name, c.coverage_level, c.rule_count,
       CAST(coalesce(pc.findings, 0) AS BIGINT) AS findings, s.risk_score, sc.overall_score
FROM summ s CROSS JOIN cov2 c CROSS JOIN sc
LEFT JOIN pc ON pc.project_id = s.project_id AND pc.owasp = c.owasp"""))
def q_owasp_report(ws):
    """Per project, every category's coverage with the project's
    findings in it, the project risk score and the catalogue score."""
    f = findings(ws)
    summ = report.scan_summary(f, collected(ws)).select("project_id", "risk_score")
    cov = C.coverage(ws.spark)
    pc = f.groupBy("project_id", "owasp").agg(F.count("*").cast("bigint").alias("findings"))
    # every project gets the 11 category codes from a literal array (a
    # generator, not a join); catalogue columns come by equi-join
    cats = F.array(*[F.lit(c) for c in OWASP_NAMES])
    # the catalogue score is a column of the 11-row coverage table, so the
    # grid needs only key joins
    cov_s = C.with_score(cov)
    grid = (summ.select("project_id", "risk_score", F.explode(cats).alias("owasp"))
            .join(F.broadcast(cov_s.select("owasp", "name", "coverage_level", "rule_count", "overall_score")), "owasp"))
    return (grid.join(pc, ["project_id", "owasp"], "left").fillna(0, ["findings"])
            .select("project_id", "owasp", "name", "coverage_level", "rule_count", "findings", "risk_score",
                    "overall_score"))
