"""Behaviour scan and package risk queries."""

from __future__ import annotations


from chainscope.catalog.reference import KNOWN_SAFE
from chainscope.functions.regex import sql_str
from chainscope.functions.sizing import spread
from chainscope.operators import risk, scan
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures
from chainscope.plans.scan_queries import o_ext, o_in_dirs
from chainscope.sources import files as S

PKG = risk.PKG
BF_OUT = ["project_id", "package", "version", "rule", "severity", "category", "file", "line", "col", "snippet"]


# ------------------------------------------------------------------ Spark side

def package_files(ws):
    return ws.memo("package_files", lambda: spread(S.collect_package_files(ws.table("src_files")),
                                                        PKG + ["path"]))


def behavior_findings(ws, dedup=True):
    return scan.scan_behavior(package_files(ws), keep=tuple(PKG + ["path"]), dedup=dedup)


def package_risk(ws):
    return risk.package_risk(behavior_findings(ws), package_files(ws))


def adjusted(ws):
    f = behavior_findings(ws)
    return risk.apply_known_safe(risk.package_risk(f, package_files(ws)), risk.category_counts(f),
                                 risk.known_safe_frame(ws.spark))


# ------------------------------------------------------------------ oracle side

def o_package_files():
    exts = ", ".join(sql_str(e) for e in S.PACKAGE_EXTENSIONS)
    return [("pf", f"""
SELECT * FROM src_files
WHERE {o_ext('path')} IN ({exts}) AND NOT {o_in_dirs('path', S.PACKAGE_SKIP_DIRS)}""")]


def o_brules():
    rows = [(r["rule_idx"], r["rule"], r["severity"], r["category"], r["re2"]) for r in scan.behavior_rules()]
    return ("brules", Q.values_cte(["rule_idx", "rule", "severity", "category", "pat"], rows))


def o_bf(dedup=True):
    return (o_package_files() + [o_brules()]
            + Q.match_ctes("pf", "brules", ["rule_idx", "rule", "severity", "category"], PKG + ["path"], dedup,
                           prefix="b")
            + [("bf", "SELECT * EXCLUDE (path), path AS file FROM b_out")])


def o_risk():
    keys = ", ".join(PKG)
    sev = ", ".join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s}" for s in ["critical", "high", "medium", "low"])
    raw = "(critical * 3.0 + high * 2.0 + medium * 1.0 + low * 0.3)"
    score = f"CASE WHEN findings = 0 THEN 0.0 ELSE {Q.round1('10.0 * (1.0 - exp(-' + raw + ' / 8.0))')} END"
    parts = ", ".join(f"CASE WHEN {s} > 0 THEN CAST({s} AS VARCHAR) || ' {s}' END"
                      for s in ["critical", "high", "medium", "low"])
    label = ("CASE WHEN score >= 7 THEN 'DANGEROUS' WHEN score >= 4 THEN 'SUSPICIOUS' "
             "WHEN score >= 2 THEN 'CAUTION' ELSE 'LOW RISK' END")
    return o_bf() + [
        ("bagg", f"SELECT {keys}, CAST(count(*) AS BIGINT) AS findings, {sev} FROM bf GROUP BY {keys}"),
        ("bsc", f"SELECT {keys}, CAST(count(*) AS BIGINT) AS files_scanned FROM pf GROUP BY {keys}"),
        ("pr0", f"""
SELECT bsc.*, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
       coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM bsc LEFT JOIN bagg USING ({keys})"""),
        ("pr1", f"SELECT *, CAST({score} AS DOUBLE) AS score FROM pr0"),
        ("pr", f"""
SELECT *, CASE WHEN findings = 0 THEN 'No suspicious patterns found.'
          ELSE 'Risk: ' || {label} || ' (' || {Q.js_num('score')} || '/10) — ' || CAST(findings AS VARCHAR)
               || ' findings: ' || concat_ws(', ', {parts}) END AS summary
FROM pr1"""),
    ]


def o_known_safe():
    rows = ",\n".join(
        f"({sql_str(n)}, {float(m)!r}, {'CAST([] AS VARCHAR[])' if not c else '[' + ', '.join(sql_str(x) for x in c) + ']'})"
        for n, m, c in KNOWN_SAFE)
    return ("ks", f"SELECT * FROM (VALUES {rows}) AS t(package, max_allowed_score, suppress_categories)")


def o_adjusted():
    keys = ", ".join(PKG)
    return o_risk() + [o_known_safe(),
                       ("cc", f"SELECT {keys}, category, CAST(count(*) AS BIGINT) AS count FROM bf GROUP BY {keys}, category"),
                       ("uns", f"""
SELECT {', '.join('cc.' + k for k in PKG)}, sum(count) AS unsup
FROM cc JOIN ks ON cc.package = ks.package
WHERE NOT list_contains(ks.suppress_categories, cc.category)
GROUP BY {', '.join('cc.' + k for k in PKG)}"""),
                       ("adj0", f"""
SELECT pr.*, ks.max_allowed_score, ks.package IS NOT NULL AS known_safe,
       coalesce((ks.package IS NOT NULL AND coalesce(uns.unsup, 0) = 0)
                OR (ks.package IS NOT NULL AND pr.score <= ks.max_allowed_score), FALSE) AS suppressed
FROM pr LEFT JOIN ks ON pr.package = ks.package
LEFT JOIN uns ON pr.project_id = uns.project_id AND pr.package = uns.package AND pr.version = uns.version"""),
                       ("adj", "SELECT *, CASE WHEN suppressed THEN 0.0 ELSE score END AS adjusted_score FROM adj0")]


RISK_OUT = PKG + ["files_scanned", "findings", "critical", "high", "medium", "low", "score", "summary"]


# ------------------------------------------------------------------ queries

@query("behavior_findings", lambda: with_fixtures(["src_files"], o_bf(), f"SELECT {', '.join(BF_OUT)} FROM bf"))
def q_behavior_findings(ws):
    return behavior_findings(ws).select(*BF_OUT)


@query("scan_column", lambda: with_fixtures(["src_files"], o_bf(dedup=False), f"SELECT {', '.join(BF_OUT)} FROM bf"))
def q_scan_column(ws):
    """The behaviour rules over a string column, no de-duplication."""
    out = scan.scan_column(package_files(ws), "content", PKG + ["path"])
    return out.withColumnRenamed("path", "file").select(*BF_OUT)


@query("package_risk", lambda: with_fixtures(["src_files"], o_risk(), f"SELECT {', '.join(RISK_OUT)} FROM pr"))
def q_package_risk(ws):
    return package_risk(ws).select(*RISK_OUT)


@query("category_counts", lambda: with_fixtures(["src_files"], o_bf(), f"""
SELECT {', '.join(PKG)}, category, CAST(count(*) AS BIGINT) AS count FROM bf GROUP BY {', '.join(PKG)}, category"""))
def q_category_counts(ws):
    return risk.category_counts(behavior_findings(ws))


@query("risk_bands", lambda: with_fixtures(["src_files"], o_risk(), f"""
SELECT {', '.join(PKG)}, score,
       CASE WHEN score >= 7 THEN 'DANGEROUS' WHEN score >= 4 THEN 'SUSPICIOUS' WHEN score >= 2 THEN 'CAUTION'
            ELSE 'LOW RISK' END AS label,
       CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS band,
       score >= 4 AS attention
FROM pr"""))
def q_risk_bands(ws):
    return risk.risk_bands(package_risk(ws)).select(*PKG, "score", "label", "band", "attention")


@query("risk_ranking", lambda: with_fixtures(["src_files"], o_risk(), f"""
SELECT {', '.join(PKG)}, score,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, package, version) AS BIGINT) AS rank
FROM pr"""))
def q_risk_ranking(ws):
    return risk.risk_ranking(package_risk(ws)).select(*PKG, "score", "rank")


@query("apply_known_safe", lambda: with_fixtures(["src_files"], o_adjusted(), f"""
SELECT {', '.join(PKG)}, score, known_safe, suppressed, adjusted_score FROM adj"""))
def q_apply_known_safe(ws):
    return adjusted(ws).select(*PKG, "score", "known_safe", "suppressed", "adjusted_score")


@query("audit_summary", lambda: with_fixtures(["src_files"], o_adjusted() + [
    ("decl", f"SELECT project_id, count(*) AS n FROM (SELECT DISTINCT {', '.join(PKG)} FROM src_files) GROUP BY project_id"),
    ("sc", """
SELECT project_id, count(*) AS scanned, sum(CAST(adjusted_score AS DECIMAL(18,6))) AS total, max(adjusted_score) AS max_score,
       count_if(adjusted_score >= 4) AS attention, count_if(adjusted_score >= 7) AS high_risk,
       (min({'s': -adjusted_score, 'p': package})).p AS top
FROM adj GROUP BY project_id""")], f"""
SELECT d.project_id, CAST(n AS BIGINT) AS packages, CAST(coalesce(scanned, 0) AS BIGINT) AS scanned,
       {Q.round1('CAST(coalesce(total, 0) AS DOUBLE) / n')} AS mean_score, coalesce(max_score, 0.0) AS max_score,
       CAST(coalesce(attention, 0) AS BIGINT) AS attention, CAST(coalesce(high_risk, 0) AS BIGINT) AS high_risk,
       CASE WHEN max_score > 0 THEN top ELSE '' END AS max_package
FROM decl d LEFT JOIN sc USING (project_id)"""))
def q_audit_summary(ws):
    return risk.audit_summary(adjusted(ws), ws.table("src_files").select(*PKG).distinct())


# ------------------------------------------------------------------ remediation

from chainscope.operators import remediation as RM  # noqa: E402


def suggestions(ws):
    return RM.suggestions(package_risk(ws), behavior_findings(ws), ws.spark)


def o_sugg():
    keys = ", ".join(PKG)
    alts = [(p, i, n, r, c) for p, al in RM.ALTERNATIVES.items() for i, (n, r, c) in enumerate(al)]
    acts = [(k, *v) for k, v in RM.CATEGORY_ACTIONS.items()]
    return o_risk() + [
        ("alts", Q.values_cte(["package", "alt_idx", "alt", "reason", "complexity"], alts)),
        ("acts", Q.values_cte(["category", "title", "description", "action", "type"], acts)),
        ("rep", "SELECT p.*, a.alt, a.reason, a.complexity FROM pr p LEFT JOIN alts a ON a.package = p.package AND a.alt_idx = 0"),
        ("catg", f"""
SELECT {keys}, category, CAST(count(*) AS BIGINT) AS n,
       min({{'s': {Q.sev_rank('severity')}, 'f': file, 'l': line, 'r': rule_idx, 'c': col}}) AS first,
       max(CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE 0 END) AS sev
FROM bf GROUP BY {keys}, category"""),
        ("sugg", f"""
SELECT {keys}, CAST(0 AS BIGINT) AS seq, 'replace' AS type, CASE WHEN score >= 7 THEN 'critical' ELSE 'high' END AS priority,
       'Replace ' || package || ' with ' || alt AS title, reason AS description,
       'npm uninstall ' || package || ' && npm install ' || alt AS action,
       CASE complexity WHEN 'drop-in' THEN 'trivial' WHEN 'minor-changes' THEN 'low' ELSE 'medium' END AS effort
FROM rep WHERE alt IS NOT NULL
UNION ALL
SELECT {', '.join('c.' + k for k in PKG)}, CAST(dense_rank() OVER (PARTITION BY {', '.join('c.' + k for k in PKG)} ORDER BY c.first) AS BIGINT),
       a.type, CASE c.sev WHEN 2 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END, a.title,
       a.description || ' (' || CAST(c.n AS VARCHAR) || ' finding' || CASE WHEN c.n <> 1 THEN 's' ELSE '' END || ')',
       a.action, 'low'
FROM catg c JOIN acts a ON a.category = c.category
UNION ALL
SELECT {keys}, CAST(1000 AS BIGINT), 'remove', 'critical', 'Consider removing ' || package,
       'Risk score ' || {Q.js_num('score')} || '/10 is dangerously high with no known safe alternatives',
       'npm uninstall ' || package || '. Find a replacement or implement the functionality directly.', 'high'
FROM rep WHERE score >= 8 AND alt IS NULL
UNION ALL
SELECT {keys}, CAST(1001 AS BIGINT), 'monitor', 'low', 'Pin and monitor ' || package,
       'Pin exact version and monitor for behavioral changes',
       'Use exact version in package.json: "' || package || '": "' || version || '"', 'trivial'
FROM rep WHERE score >= 2"""),
    ]


@query("suggestions", lambda: with_fixtures(["src_files"], o_sugg(), f"SELECT {', '.join(RM.OUT)} FROM sugg"))
def q_suggestions(ws):
    return suggestions(ws).select(*RM.OUT)


@query("top_suggestions", lambda: with_fixtures(["src_files"], o_sugg(), f"""
SELECT * FROM (
  SELECT {', '.join(RM.OUT)}, CAST(row_number() OVER (PARTITION BY {', '.join(PKG)} ORDER BY
         CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, seq) AS BIGINT) AS rank
  FROM sugg) WHERE rank <= 3"""))
def q_top_suggestions(ws):
    return RM.top_suggestions(suggestions(ws)).select(*RM.OUT, "rank")


@query("remediation_summary", lambda: with_fixtures(["src_files"], o_sugg() + [
    ("rs", """
SELECT s.project_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(priority = 'critical') AS BIGINT) AS critical, CAST(count_if(priority = 'high') AS BIGINT) AS high,
       CAST(count_if(priority = 'medium') AS BIGINT) AS medium, CAST(count_if(priority = 'low') AS BIGINT) AS low,
       CAST(sum(CASE effort WHEN 'trivial' THEN 0.25 WHEN 'low' THEN 1.0 WHEN 'medium' THEN 4.0 ELSE 8.0 END) AS DOUBLE)
         AS effort_hours,
       CAST(count(DISTINCT (s.project_id, s.package, s.version)) AS BIGINT) AS packages
FROM sugg s JOIN (SELECT {keys} FROM pr WHERE score >= 1) k
  ON k.project_id = s.project_id AND k.package = s.package AND k.version = s.version
GROUP BY s.project_id""".replace("{keys}", ", ".join(PKG)))], f"""
SELECT *, CASE WHEN effort_hours < 1 THEN '<1 hour'
               WHEN effort_hours < 8 THEN '~' || CAST({Q.js_round('effort_hours')} AS VARCHAR) || ' hours'
               ELSE '~' || CAST({Q.js_round('effort_hours / 8')} AS VARCHAR) || ' days' END AS estimated_effort
FROM rs"""))
def q_remediation_summary(ws):
    return RM.remediation_summary(package_risk(ws), suggestions(ws))
