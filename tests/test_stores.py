"""Round trips of the table stores."""

from pathlib import Path

from pyspark.sql import functions as F

from chainscope.operators import fingerprint as P
from chainscope.operators import history as H
from chainscope.session import shared_dir
from chainscope.sources import stores
from chainscope.sources.fixtures import Workspace
from tests.conftest import SF_SMALL


def _files(spark, n):
    """n packages of two files each, with imports and an endpoint."""
    return spark.range(2 * n).select(
        (F.col("id") % 7).cast("string").alias("project_id"), F.concat(F.lit("pkg-"), F.floor(F.col("id") / 2)).alias("package"), F.lit("1.0").alias("version"),
        F.concat(F.lit("src/"), F.col("id") % 2, F.lit(".js")).alias("path"),
        F.concat(F.lit("require('dep-"), F.col("id") % 5, F.lit("'); fetch('https://h"), F.col("id") % 3, F.lit(".example/x')")).alias("content"))


def _folders(path):
    return {p.parent.name for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_profile_store_of_many_packages(spark):
    rows = P.profile_rows(_files(spark, 100_000), stores.PROFILE_KEYS)
    path = shared_dir(spark, "profiles")
    stores.save_profiles(rows, path, 1)
    assert len(_folders(path)) <= stores.PROFILE_BUCKETS
    back = stores.load_profiles(spark, path)
    assert back.count() == rows.count() and back.select(*rows.columns).exceptAll(rows).isEmpty()


def test_profile_lookup_reads_one_folder_and_the_last_save(spark):
    rows = P.profile_rows(_files(spark, 500), stores.PROFILE_KEYS)
    path, small = shared_dir(spark, "profiles"), shared_dir(spark, "profiles")
    stores.save_profiles(rows, path, 1)
    changed = rows.where("package = 'pkg-17' and kind = 'file'").withColumn("sha256", F.lit("0" * 64))
    stores.save_profiles(changed, path, 2)
    for where in (path, small):
        if where == small:
            stores.compact_profiles(spark, path, small)
        one = stores.load_profile(spark, where, "pkg-17", "1.0")
        assert sorted(map(tuple, one.select(*rows.columns).collect())) == sorted(map(tuple, changed.collect()))
        assert {Path(f).parent.name for f in one.inputFiles()} <= _folders(where)
        scan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in scan and "PushedFilters" in scan
        other = rows.where("package = 'pkg-18'")
        assert sorted(map(repr, stores.load_profile(spark, where, "pkg-18").select(*rows.columns).collect())) == sorted(map(repr, other.collect()))
    assert stores.load_profile(spark, path, "none").isEmpty()
    assert len(list(Path(small.removeprefix("file:")).rglob("*.parquet"))) <= stores.PROFILE_BUCKETS


def test_snapshot_store_keeps_newest(spark):
    ws = Workspace.of(spark, SF_SMALL)
    snaps = H.posture_snapshots(ws.table("observations"))
    path = shared_dir(spark, "snapshots")
    stores.save_snapshots(snaps, path)
    got = stores.load_snapshots(spark, path, limit=3)
    per = {r[0]: r[1] for r in got.groupBy("project_id").count().collect()}
    assert per and all(v <= 3 for v in per.values())


def test_config_table_default_and_round_trip(spark):
    path = shared_dir(spark, "policy")
    pol = stores.load_table(spark, path, stores.POLICY_SCHEMA, stores.default_policy(spark))
    assert pol.count() == 6 and pol.where("enabled").count() == 5
    stores.save_table(pol, path)
    assert stores.load_table(spark, path, stores.POLICY_SCHEMA).count() == 6
