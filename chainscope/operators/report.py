"""Scan summaries: counts, top rules, risk score, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import group_rank, top_k_per_group
from chainscope.operators.scan import severity_rank

SEVERITIES = ["critical", "high", "medium", "low", "info"]
CONFIDENCES = ["high", "medium", "low"]


def source_risk(critical, high, medium, low):
    """0-100 risk: min(100, round(100 * (1 - e^(-raw/20))))."""
    raw = critical * 10 + high * 5 + medium * 2 + low * 0.5
    return F.least(F.lit(100), js.js_round(F.lit(100.0) * (F.lit(1.0) - F.exp(-raw / F.lit(20.0))))).cast("bigint")


def scan_summary(findings: DataFrame, files: DataFrame, project_col: str = "project_id") -> DataFrame:
    """A1+A3: one row per project with the totals of the scan report."""
    def n_if(cond):
        return F.count(F.when(cond, 1)).cast("bigint")
    agg = findings.groupBy(project_col).agg(
        F.count("*").cast("bigint").alias("total_findings"),
        F.countDistinct("file").cast("bigint").alias("files_with_findings"),
        *[n_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        *[n_if(F.col("confidence") == c).alias(f"conf_{c}") for c in CONFIDENCES],
    )
    nfiles = files.groupBy(project_col).agg(F.count("*").cast("bigint").alias("total_files"))
    out = nfiles.join(agg, project_col, "left")
    zero_cols = ["total_findings", "files_with_findings", *SEVERITIES, *[f"conf_{c}" for c in CONFIDENCES]]
    out = out.fillna(0, subset=zero_cols)
    return out.withColumn("risk_score", source_risk(F.col("critical"), F.col("high"), F.col("medium"), F.col("low")))


GROUPINGS = ["severity", "confidence", "owasp", "cwe"]


def scan_counts(findings: DataFrame, project_col: str = "project_id") -> DataFrame:
    """A1: the report's counts by severity, confidence, category and CWE, as rows
    (project, grouping, value, findings), all from one pass and one shuffle
    (GROUPING SETS; rows of a project are counted before they are sent)."""
    by = GROUPINGS
    cols = [F.col(project_col), *(F.col(c).cast("string").alias(c) for c in by)]
    rows = findings.select(*cols)
    counted = rows.groupingSets([[F.col(project_col), F.col(c)] for c in by], F.col(project_col), *(F.col(c) for c in by)).agg(
        F.grouping_id().alias("_id"), F.count("*").cast("bigint").alias("findings"))
    # the grouping id has a bit for each column that is not in the set, the project's first
    bit = {c: (1 << len(by)) - 1 - (1 << (len(by) - 1 - k)) for k, c in enumerate(by)}
    grouping, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in by:
        grouping, value = F.when(F.col("_id") == bit[c], c).otherwise(grouping), F.when(F.col("_id") == bit[c], F.col(c)).otherwise(value)
    return counted.select(project_col, grouping.alias("grouping"), value.alias("value"), "findings")


def first_seen_key(findings: DataFrame):
    """Position of a finding in the report order (severity, file, line)."""
    return F.struct(severity_rank().alias("s"), F.col("file").alias("f"), F.col("line").alias("l"),
                    F.col("rule_idx").alias("r"), F.col("col").alias("c"))


def top_rules(findings: DataFrame, k: int = 10, project_col: str = "project_id") -> DataFrame:
    """A2: k most frequent rules per project; ties by first appearance in
    the ranked findings."""
    counts = findings.groupBy(project_col, "rule_id").agg(
        F.count("*").cast("bigint").alias("count"), F.min(first_seen_key(findings)).alias("_first"))
    return top_k_per_group(counts, [project_col], [F.col("count").desc(), F.col("_first")], k).drop("_first")


def top_issues(top: DataFrame, rules: DataFrame) -> DataFrame:
    """Top rules with their catalogue severity (medium when unknown)."""
    sev = rules.select("rule_id", F.col("severity").alias("_sev"))
    return (top.join(F.broadcast(sev), "rule_id", "left")
            .withColumn("severity", F.coalesce("_sev", F.lit("medium"))).drop("_sev"))


def ranked_findings(findings: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Report order as a rank column (severity, file, line)."""
    return group_rank(findings, [project_col],
                      [severity_rank(), F.col("file"), F.col("line"), F.col("rule_idx"), F.col("col")],
                      lead=[(severity_rank(), False), (F.col("file"), False)])
