"""Metamorphic properties of the inventory operators."""

from pyspark.sql import functions as F

from chainscope.operators import fingerprint as P
from chainscope.operators import lockdiff
from chainscope.sources.fixtures import Workspace
from tests.conftest import SF_SMALL


def test_swapping_snapshots_swaps_added_and_removed(spark):
    lock = Workspace.of(spark, SF_SMALL).table("lock_packages")
    fwd = lockdiff.lock_diff(lock, "old", "new")
    back = lockdiff.lock_diff(lock, "new", "old")
    f = {(r.project_id, r.name, r.type) for r in fwd.collect()}
    b = {(r.project_id, r.name, {"added": "removed", "removed": "added"}.get(r.type, r.type)) for r in back.collect()}
    assert f == b and f


def test_upgrade_becomes_downgrade(spark):
    lock = Workspace.of(spark, SF_SMALL).table("lock_packages")
    up = lockdiff.semver_changes(lockdiff.lock_diff(lock, "old", "new"))
    down = lockdiff.semver_changes(lockdiff.lock_diff(lock, "new", "old"))
    ups = {(r.project_id, r.name) for r in up.where("downgrade").collect()}
    bigger = {(r.project_id, r.name) for r in down.where(~F.col("downgrade") & (F.col("old_version") != F.col("new_version"))).collect()}
    assert ups <= bigger


def test_profile_diff_with_itself_is_empty(spark):
    files = Workspace.of(spark, SF_SMALL).table("src_files")
    assert P.profile_diff(files, files, ["project_id", "package"]).count() == 0


def test_reapplying_list_changes_changes_nothing(spark):
    from chainscope.operators import govern as G
    ws = Workspace.of(spark, SF_SMALL)
    entries, changes = ws.table("list_entries"), ws.table("list_changes")
    once = G.list_mutations(entries, changes)
    # the same changes again, later in time
    again = changes.unionByName(changes.withColumn("ts", F.col("ts") + F.expr("INTERVAL 365 DAYS"))
                                .withColumn("event_id", F.col("event_id") + 10 ** 9))
    twice = G.list_mutations(entries, again)
    key = ["list", "name", "version", "reason"]
    assert sorted(map(tuple, once.select(*key).collect())) == sorted(map(tuple, twice.select(*key).collect()))


def test_golden_scores_through_operators(spark):
    from chainscope.operators import report, risk
    f = spark.createDataFrame([("p", "pkg", "1", "critical")], "project_id string, package string, "
                                                             "version string, severity string")
    files = spark.createDataFrame([("p", "pkg", "1", "a.js")], "project_id string, package string, "
                                                              "version string, path string")
    assert risk.package_risk(f, files).first().score == 3.1
    one = spark.range(1).select(report.source_risk(F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("r"))
    assert one.first().r == 39
