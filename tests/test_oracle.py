"""Spark plans against the DuckDB oracle on the smallest data folder."""

import pytest

import __spark_entry__ as E
from chainscope.plans.registry import QUERIES
from tests.conftest import SF_SMALL
from tests.harness import compare, duck

ORACLE = E.oracle_sql()
CHECKED = ["project_scan", "dedup_findings", "ranked_findings", "scan_summary", "top_rules", "collect_files",
           "behavior_findings", "package_risk", "apply_known_safe", "audit_summary", "typosquat", "name_similarity",
           "lock_diff", "lock_flags", "lock_diff_summary", "semver_changes", "detect_license", "license_violations",
           "maintainer_risk", "provenance", "fingerprint_profile", "profile_diff", "policy_results", "list_check",
           "list_mutations", "access_check", "manifest_generate", "gate_checks", "compliance_summary", "suggestions", "top_suggestions",
           "monitor_check", "monitor_status", "posture_trend", "posture_compare", "parse_lockfile",
           "sbom_components", "spdx_relationships", "owasp_report", "coverage_score",
           "scan_counts", "finding_details", "fingerprint_rows", "policy_operators", "posture_snapshots", "posture_high_risk",
           "posture_compare_summary", "sbom_cyclonedx", "sbom_spdx", "compliance_notes", "denied_packages", "lock_delta_lists",
           "license_list", "provenance_summary", "monitor_file_events"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    problems, ns, nd = compare(E.queries()[name](spark, SF_SMALL), con, ORACLE[name])
    assert not problems, problems


def test_every_query_has_oracle_or_reason():
    assert set(QUERIES) <= set(ORACLE)


def test_coverage_score_golden(spark):
    row = E.queries()["coverage_score"](spark, SF_SMALL).first()
    assert (row.overall_score, row.overall_level, row.total_rules, row.total_cwes) == (88, "Strong", 99, 60)


def test_single_gap_golden(spark):
    gaps = [r.gap for r in E.queries()["coverage_gaps"](spark, SF_SMALL).collect()]
    assert gaps == ["A10:2021 Server-Side Request Forgery: Only 1 unique CWE(s) covered"]
