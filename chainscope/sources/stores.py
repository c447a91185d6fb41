"""Table stores: profiles, posture snapshots, config tables, JSON reports.

Everything is a Parquet/JSON table under a folder the caller chooses --
on a cluster, a folder of the shared store (see ``session.shared_dir``).
Reads filter on partition columns, so a lookup by name or by day reads
only its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.operators import govern as G


#: Folders of a profile store, whatever the number of packages.
PROFILE_BUCKETS = 64
PROFILE_KEYS = ["project_id", "package", "version"]


def _bucket(package) -> Column:
    return F.pmod(F.xxhash64(package), F.lit(PROFILE_BUCKETS)).cast("int")


def save_profiles(rows: DataFrame, path: str, saved: int) -> None:
    """Append profiles, given as rows (project_id, package, version, kind,
    value, ...: every file hash and item, see ``fingerprint.profile_rows``).

    Packages are hashed to a fixed number of folders; a save writes one file to
    each.  ``saved`` numbers the saves, in ascending order: of the saves of a
    profile the last one counts, as a whole.
    """
    placed = rows.withColumns({"bucket": _bucket(F.col("package")), "saved": F.lit(saved).cast("long")})
    placed.repartition(PROFILE_BUCKETS, "bucket").sortWithinPartitions("bucket", *PROFILE_KEYS).write.mode("append").partitionBy("bucket").parquet(path)


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("bucket", *PROFILE_KEYS).agg(F.max("saved").alias("saved"))
    return rows.join(last, ["bucket", *PROFILE_KEYS, "saved"], "left_semi")


def load_profile(spark: SparkSession, path: str, package: str, version: str | None = None) -> DataFrame:
    """The rows of one package's profiles, as last saved.  Only the package's
    folder is read, and in its sorted files only the row groups that may hold it."""
    df = spark.read.parquet(path).where((F.col("bucket") == _bucket(F.lit(package))) & (F.col("package") == package))
    df = df.where(F.col("version") == version) if version is not None else df
    return _newest(df).drop("bucket", "saved")


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """All profiles as last saved."""
    return _newest(spark.read.parquet(path)).drop("bucket", "saved")


def compact_profiles(spark: SparkSession, path: str, target: str) -> None:
    """Writes the store anew to ``target``, without saves that were
    replaced, a file for each folder.  Saves go on there."""
    rows = _newest(spark.read.parquet(path))
    rows.repartition(PROFILE_BUCKETS, "bucket").sortWithinPartitions("bucket", *PROFILE_KEYS).write.partitionBy("bucket").parquet(target)


def save_snapshots(snaps: DataFrame, path: str) -> None:
    """Append posture snapshots, partitioned by day."""
    snaps.write.mode("append").partitionBy("day").parquet(path)


def load_snapshots(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Newest ``limit`` snapshots per project, oldest first."""
    from chainscope.operators.history import latest_snapshots
    return latest_snapshots(spark.read.parquet(path), limit)


POLICY_SCHEMA = G.POLICY_SCHEMA
LIST_SCHEMA = "list string, name string, version string, reason string, added_by string, seq bigint, expires_at string"
MANIFEST_SCHEMA = ("project_id string, name string, net_blocked boolean, net string, fs_blocked boolean, fs string, "
                   "native boolean, exec boolean, env_mode string, env string")


LICENSE_POLICY_SCHEMA = "allowed array<string>, denied array<string>, copyleft_allowed boolean, require_license boolean, exceptions array<string>"
GATE_SCHEMA = ("max_risk_score double, max_critical bigint, max_high bigint, block_on_license boolean, block_on_policy boolean, "
               "block_on_denied boolean")


def default_policy(spark: SparkSession) -> DataFrame:
    return G.policy_frame(spark)


def load_config(spark: SparkSession, path: str, schema: str) -> dict:
    """A one-row config table (license policy, gate) as the overrides that
    ``license.violations`` and ``govern.gate_checks`` take; fields it leaves out
    keep their defaults, and so does all of it where there is no table."""
    row = load_table(spark, path, schema).head()
    return {} if row is None else {k: v for k, v in row.asDict().items() if v is not None}


def load_table(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """A JSON-lines config table with a fixed schema; the default (or
    an empty table) when the folder does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).json(path)
    return default if default is not None else spark.createDataFrame([], schema)


def save_table(df: DataFrame, path: str) -> None:
    """Write a config table (JSON lines, replacing the previous one)."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """A report table as JSON lines (one object per row)."""
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.json(path)


def write_documents(rows: DataFrame, path: str, key: str = "project_id", order: tuple[str, ...] = ("section", "n")) -> None:
    """Documents given as ordered rows (key, *order, text), a folder for
    each.  A document's files in order of their names are its text: rows are
    range-partitioned and sorted, so a large document is several files, each
    written by a task of its own and committed with the job."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    placed.select(key, F.col("text").alias("value")).write.partitionBy(key).option("compression", "none").text(path)


def read_documents(spark: SparkSession, path: str, key: str = "project_id") -> DataFrame:
    """The rows (key, file, place, text) of written documents; their order is that of file and place."""
    lines = spark.read.text(path, wholetext=True).select(key, F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("_l"))
    return lines.select(key, "file", F.posexplode("_l").alias("place", "text")).where(F.col("text") != "")
