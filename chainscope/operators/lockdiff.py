"""Lockfile snapshots: diff, semver, delta flags, dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.functions.ranking import group_rank

# FIXED VALUES — package names treated as network-capable / native
NETWORK_PACKAGES = ["node-fetch", "axios", "got", "request", "superagent", "undici",
                    "http-proxy", "http-proxy-agent", "https-proxy-agent", "socks-proxy-agent",
                    "socket.io", "ws", "websocket", "net", "dgram"]
NATIVE_PACKAGES = ["node-gyp", "node-pre-gyp", "prebuild-install", "nan", "napi",
                   "sharp", "bcrypt", "better-sqlite3", "canvas", "grpc",
                   "sqlite3", "pg-native", "libxmljs"]

SEMVER = r"^(\d+)\.(\d+)\.(\d+)"


def semver(v: Column) -> Column:
    """struct(major, minor, patch) or null when unparsable."""
    parts = [F.regexp_extract(v, SEMVER, i) for i in (1, 2, 3)]
    return F.when(v.rlike(SEMVER), F.struct(parts[0].cast("bigint").alias("major"),
                                            parts[1].cast("bigint").alias("minor"),
                                            parts[2].cast("bigint").alias("patch")))


def lock_diff(lock: DataFrame, old: str = "old", new: str = "new", keys: list[str] = ("project_id",)) -> DataFrame:
    """Full outer join of two snapshots on (project, name); added,
    removed, or changed when the versions differ; equal rows dropped."""
    keys = list(keys)
    cols = ["version", "has_install_script", "has_bin"]
    o = lock.where(F.col("snapshot") == old).select(*keys, "name", *[F.col(c).alias("old_" + c) for c in cols])
    n = lock.where(F.col("snapshot") == new).select(*keys, "name", *[F.col(c).alias("new_" + c) for c in cols])
    j = o.join(n, keys + ["name"], "full_outer")
    typ = (F.when(F.col("old_version").isNull() & F.col("new_version").isNotNull(), "added")
           .when(F.col("new_version").isNull() & F.col("old_version").isNotNull(), "removed")
           .when(~F.col("old_version").eqNullSafe(F.col("new_version")), "changed"))
    return j.withColumn("type", typ).where(F.col("type").isNotNull())


def delta_lists(diff: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Each project's added, removed and changed packages numbered by name."""
    return group_rank(diff, [*keys, "type"], [F.col("name")], lead=[(F.substring("name", 1, 8), False)])


def semver_changes(diff: DataFrame) -> DataFrame:
    """Major bump and downgrade of changed packages."""
    o, n = semver(F.col("old_version")), semver(F.col("new_version"))
    ok = o.isNotNull() & n.isNotNull()
    return (diff.where(F.col("type") == "changed")
            .withColumn("major_bump", F.coalesce(ok & (n["major"] > o["major"]), F.lit(False)))
            .withColumn("downgrade", F.coalesce(ok & (n < o), F.lit(False))))


def lock_flags(diff: DataFrame, edges: DataFrame, old: str = "old", new: str = "new",
               keys: list[str] = ("project_id",)) -> DataFrame:
    """R7 + U5: one row per delta flag (project, name, flag, message).

    Flags of added packages: install script, native, network, bin.
    Flags of changed packages: major bump, downgrade, install script added,
    and one ``new-dependency`` per dependency key new in the new snapshot.
    ``edges`` are (*keys, snapshot, name, dep), distinct.
    """
    keys = list(keys)
    name = F.col("name")
    sv = semver_changes(diff)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    added = diff.where(F.col("type") == "added")
    added_flags = F.array(
        F.when(F.col("new_has_install_script"), F.struct(F.lit("new-install-script").alias("flag"), F.concat(
            F.lit('New package '), q(name), F.lit(" has install scripts")).alias("message"))),
        F.when(name.isin(NATIVE_PACKAGES), F.struct(F.lit("new-native-module").alias("flag"), F.concat(
            F.lit('New package '), q(name), F.lit(" is a native module")).alias("message"))),
        F.when(name.isin(NETWORK_PACKAGES), F.struct(F.lit("new-network-dep").alias("flag"), F.concat(
            F.lit('New package '), q(name), F.lit(" has network capabilities")).alias("message"))),
        F.when(F.col("new_has_bin"), F.struct(F.lit("new-bin").alias("flag"), F.concat(
            F.lit('New package '), q(name), F.lit(" installs binaries")).alias("message"))),
    )
    vers = F.concat(F.col("old_version"), F.lit(" -> "), F.col("new_version"))
    changed_flags = F.array(
        F.when(F.col("major_bump"), F.struct(F.lit("major-bump").alias("flag"), F.concat(
            q(name), F.lit(" major version bump: "), vers).alias("message"))),
        F.when(F.col("downgrade"), F.struct(F.lit("version-downgrade").alias("flag"), F.concat(
            q(name), F.lit(" version downgrade: "), vers).alias("message"))),
        F.when(~F.coalesce(F.col("old_has_install_script"), F.lit(False)) & F.col("new_has_install_script"),
               F.struct(F.lit("new-install-script").alias("flag"), F.concat(
                   q(name), F.lit(" added install scripts in "), F.col("new_version")).alias("message"))),
    )

    def explode_flags(df, arr):
        return (df.select(*keys, "name", F.explode_outer(F.filter(arr, lambda x: x.isNotNull())).alias("_f"))
                .where(F.col("_f").isNotNull())
                .select(*keys, "name", F.col("_f.flag").alias("flag"), F.col("_f.message").alias("message")))

    changed = sv
    # edges of changed packages only, and one aggregate over both snapshots
    seen = (edges.where(F.col("snapshot").isin(old, new)).join(changed.select(*keys, "name"), keys + ["name"], "left_semi")
            .groupBy(*keys, "name", "dep").agg(F.max(F.col("snapshot") == old).alias("_was")))
    new_deps = seen.where(~F.col("_was")).select(*keys, "name", "dep")
    dep_flags = (new_deps
                 .select(*keys, "name", F.lit("new-dependency").alias("flag"),
                         F.concat(q(name), F.lit(" added new dependency "), q(F.col("dep"))).alias("message")))
    return explode_flags(added, added_flags).unionByName(explode_flags(changed, changed_flags)).unionByName(dep_flags)


def diff_summary(lock: DataFrame, diff: DataFrame, flags: DataFrame, old: str = "old", new: str = "new",
                 keys: list[str] = ("project_id",)) -> DataFrame:
    """Counts per project and the summary sentence."""
    keys = list(keys)
    sizes = lock.groupBy(*keys).agg(
        F.count(F.when(F.col("snapshot") == old, 1)).cast("bigint").alias("old_count"),
        F.count(F.when(F.col("snapshot") == new, 1)).cast("bigint").alias("new_count"))
    d = diff.groupBy(*keys).agg(*[F.count(F.when(F.col("type") == t, 1)).cast("bigint").alias(t)
                                  for t in ["added", "removed", "changed"]])
    fl = flags.groupBy(*keys).agg(F.count("*").cast("bigint").alias("flags"))
    out = sizes.join(d, keys, "left").join(fl, keys, "left").fillna(0, ["added", "removed", "changed", "flags"])
    parts = F.concat_ws(", ", *[F.when(F.col(t) > 0, F.concat(F.col(t).cast("string"), F.lit(" " + t)))
                                for t in ["added", "removed", "changed", "flags"]])
    return out.withColumn("summary", F.when(parts == "", F.lit("No dependency changes"))
                          .otherwise(F.concat(F.lit("Dependency changes: "), parts)))


def dep_edges(lock: DataFrame, edges: DataFrame, snapshot: str = "new", keys: list[str] = ("project_id",)) -> DataFrame:
    """(package@version) -> (dependency@version); unknown versions '0.0.0'."""
    keys = list(keys)
    pk = lock.where(F.col("snapshot") == snapshot).select(*keys, "name", "version")
    e = edges.where(F.col("snapshot") == snapshot).select(*keys, "name", "dep")
    dv = pk.select(*keys, F.col("name").alias("dep"), F.col("version").alias("dep_version"))
    return (pk.join(e, keys + ["name"]).join(dv, keys + ["dep"], "left")
            .select(*keys, "name", "version", F.col("dep").alias("depends_on"),
                    F.coalesce("dep_version", F.lit("0.0.0")).alias("depends_on_version")))
