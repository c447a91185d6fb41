"""Policies that come from tables."""

import pytest

from chainscope.operators import govern as G
from chainscope.operators import license as L
from chainscope.session import shared_dir
from chainscope.sources import stores

CTX = "project_id string, package_name string, license string, risk_score double, is_new boolean, categories array<string>, dependency_count int"


@pytest.fixture(scope="module")
def ctx(spark):
    return spark.createDataFrame([("p", "left-pad", "MIT", 7.0, True, ["net", "fs"], 3), ("p", 'q"uote', None, 7.5, None, [], None)], CTX)


def _judge(spark, ctx, field, op, value):
    rules = G.policy_frame(spark, [("r", "Name", "Text", field, op, value, "warn", "low", True)])
    return {r.package_name: (r.passed, r.message) for r in G.policy_results(ctx, rules).collect()}


@pytest.mark.parametrize("field,op,value,first,second", [
    ("riskScore", "lte", 7, True, False), ("riskScore", "gt", "7", False, True), ("riskScore", "gte", [7.5], False, True), ("riskScore", "lt", None, False, False),
    ("riskScore", "eq", 7.0, True, False), ("riskScore", "in", [7, "7.5"], True, False), ("license", "neq", "MIT", False, True), ("license", "eq", None, False, True),
    ("categories", "contains", "net", False, False), ("categories", "eq", ["net", "fs"], False, False), ("isNew", "eq", True, True, False),
    ("packageName", "matches", r"\bpad$", True, False), ("packageName", "matches", "(", False, False), ("packageName", "contains", "", True, True),
    ("packageName", "not-in", [], True, True), ("packageName", "not-in", {"a": 1}, False, False), ("packageName", "unheard", 1, False, False), ("unheard", "not-in", ["x"], True, True),
])
def test_operators(spark, ctx, field, op, value, first, second):
    got = _judge(spark, ctx, field, op, value)
    assert (got["left-pad"][0], got['q"uote'][0]) == (first, second)


def test_messages_show_values_as_json(spark, ctx):
    assert _judge(spark, ctx, "packageName", "eq", "x")['q"uote'][1] == r'Name: Text (packageName = "q\"uote", expected eq "x")'
    assert _judge(spark, ctx, "categories", "eq", ["a", 1.0])["left-pad"][1] == 'Name: Text (categories = ["net","fs"], expected eq ["a",1])'
    assert _judge(spark, ctx, "riskScore", "gt", 7.5)["left-pad"][1] == "Name: Text (riskScore = 7, expected gt 7.5)"
    assert _judge(spark, ctx, "license", "eq", "x")['q"uote'][1] == 'Name: Text (license = null, expected eq "x")'


def test_a_loaded_policy_runs(spark, ctx):
    path = shared_dir(spark, "policy")
    missing = stores.load_table(spark, path, stores.POLICY_SCHEMA, stores.default_policy(spark))
    full = G.policy_context(ctx)
    assert G.policy_results(full, missing).count() == 2 * 5 == G.policy_results(full).count()
    stores.save_table(stores.default_policy(spark).where("id = 'max-risk-score'"), path)
    loaded = stores.load_table(spark, path, stores.POLICY_SCHEMA)
    assert {(r.package_name, r.passed) for r in G.policy_results(full, loaded).collect()} == {("left-pad", True), ('q"uote', False)}
    assert G.policy_results(full, loaded.where("false")).collect() == [] and G.policy_results(full.where("false"), loaded).collect() == []


def test_loaded_license_policy_and_gate_run(spark):
    where = shared_dir(spark, "config")
    assert stores.load_config(spark, where + "-none", stores.GATE_SCHEMA) == {}
    stores.save_table(spark.createDataFrame([(["MIT"], ["ISC"], None, True, ["skipped"])], stores.LICENSE_POLICY_SCHEMA), where)
    policy = stores.load_config(spark, where, stores.LICENSE_POLICY_SCHEMA)
    assert policy == {"allowed": ["MIT"], "denied": ["ISC"], "require_license": True, "exceptions": ["skipped"]}
    lic = spark.createDataFrame([("p", n, c, k) for n, c, k in (("a", "MIT", "permissive"), ("b", "ISC", "permissive"), ("c", "BSD-3-Clause", "permissive"), ("skipped", "ISC", "permissive"))],
                                "project_id string, name string, license string, category string")
    assert {(r.name, r.severity) for r in L.violations(lic, policy).collect()} == {("b", "critical"), ("c", "high")}
    stores.save_table(spark.createDataFrame([(9.0, None, None, None, False, None)], stores.GATE_SCHEMA), where + "-gate")
    gate = stores.load_config(spark, where + "-gate", stores.GATE_SCHEMA)
    reports = spark.createDataFrame([("p", "a", 8.0, 0, 0)], "project_id string, package string, score double, critical long, high long")
    none = spark.createDataFrame([], "project_id string, name string")
    evaluation = spark.createDataFrame([], "project_id string, blocked boolean")
    got = {r.check: r.passed for r in G.gate_checks(reports, none, evaluation, none, gate).collect()}
    assert got["Max Risk Score"] and "Policy Compliance" not in got
