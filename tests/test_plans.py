"""Plan shape: no Python on the batch path, no cartesian products, pruned scans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["project_scan", "package_risk", "typosquat", "lock_diff", "monitor_check",
                                  "fingerprint_profile", "policy_results", "gate_checks", "owasp_report"])
def test_no_python_and_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PYTHON_NODES), name
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scan_reads_only_needed_columns(spark):
    p = E.queries()["collect_files"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # listing needs the file identity only: the document text is not read
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p


def test_typosquat_joins_on_its_index(spark):
    p = plan(E.queries()["typosquat"](spark, SF_SMALL))
    assert "xxhash64" in p


@pytest.mark.parametrize("name", ["project_scan", "package_risk", "typosquat", "lock_diff", "monitor_check", "scan_summary",
                                  "lock_flags", "posture_trend", "license_violations", "fingerprint_profile"])
def test_building_a_plan_runs_no_job(spark, name):
    E.queries()[name](spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", "plan")
    E.queries()[name](spark, SF_SMALL)
    told = sc.statusTracker()
    jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup(f"build-{name}")]
    sc.setLocalProperty("spark.jobGroup.id", None)
    # what is left reads the schemas of the fourteen tables' files, one stage each
    assert len(jobs) <= 14 and all(len(j.stageIds) == 1 for j in jobs)
