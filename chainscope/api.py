"""User-level entry points: the analyzer's main flows over folders and tables.

Each function composes the operators and returns DataFrames (nothing is
collected); the caller decides where results go (``sources.stores``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.operators import license as L
from chainscope.operators import lockdiff, names, report, risk, sbom, scan
from chainscope.sources import files as S


def scan_folder(spark: SparkSession, root: str, severity_threshold: str = "low",
                confidence_threshold: str = "low", max_files: int | None = None,
                include_tests: bool = False, ignore: list[str] | None = None,
                ignore_files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Source scan of every project under ``root`` (``root/<project>/...``):
    ranked findings, per-project summary with the 0-100 risk score, top rules."""
    files = S.collect_files(S.read_tree(spark, root), ignore=ignore, include_tests=include_tests,
                            max_files=max_files, ignore_files=ignore_files)
    rules = scan.source_rules(severity_threshold, confidence_threshold)
    findings = scan.scan_source(files, rules)
    return {"findings": report.ranked_findings(findings),
            "summary": report.scan_summary(findings, files),
            "top_rules": report.top_rules(findings)}


def scan_file(spark: SparkSession, path: str, severity_threshold: str = "low", confidence_threshold: str = "low") -> DataFrame:
    """Findings of one file, in report order."""
    text = spark.read.text(path, wholetext=True).select(F.lit("").alias("project_id"), F.lit(path).alias("path"), F.col("value").alias("content"))
    return report.ranked_findings(scan.scan_source(text, scan.source_rules(severity_threshold, confidence_threshold)))


def audit_packages(spark: SparkSession, root: str, project_depth: int = 1) -> dict[str, DataFrame]:
    """Behaviour scan of package folders ``root/<project>/<package>/...``:
    findings, package risk, known-safe adjustment, per-project audit."""
    tree = S.read_tree(spark, root, project_depth)
    parts = F.split(F.col("path"), "/")
    pkg = (tree.withColumn("package", F.element_at(parts, 1))
           .withColumn("version", F.lit(""))
           .withColumn("path", F.array_join(F.slice(parts, 2, 1 << 20), "/")))
    files = S.collect_package_files(pkg)
    keys = ["project_id", "package", "version"]
    findings = scan.scan_behavior(files, keep=tuple(keys + ["path"]))
    rk = risk.package_risk(findings, files, keys)
    adjusted = risk.apply_known_safe(rk, risk.category_counts(findings, keys), risk.known_safe_frame(spark), keys)
    typos = names.typosquat(files.select(F.col("package").alias("name")), names.known_frame(spark))
    return {"findings": findings, "risk": rk, "adjusted": adjusted, "audit": risk.audit_summary(adjusted, pkg.select(*keys).distinct()),
            "typosquat": typos}


def diff_lockfiles(docs: DataFrame, old: str = "old", new: str = "new") -> dict[str, DataFrame]:
    """Diff of lockfile documents ``(project_id, snapshot, content)``:
    entries, changes, version changes, flags and the summary per project."""
    entries = sbom.parse_lockfile(docs)
    diff = lockdiff.lock_diff(entries, old, new)
    flags = lockdiff.lock_flags(diff, sbom.lock_edges(entries), old, new)
    return {"entries": entries, "diff": diff, "semver": lockdiff.semver_changes(diff), "flags": flags,
            "summary": lockdiff.diff_summary(entries, diff, flags, old, new)}


def license_report(meta: DataFrame, texts: DataFrame | None = None, policy: dict | None = None,
                   keys=("project_id", "name")) -> dict[str, DataFrame]:
    """Licenses of packages from their package.json text (``meta``) and
    optional license files (``texts``: keys, file, text); violations under ``policy``."""
    lic = L.detect(meta, texts, list(keys))
    viol = L.violations(lic, policy)
    return {"licenses": lic, "violations": viol, "summary": L.summary(lic, viol)}
