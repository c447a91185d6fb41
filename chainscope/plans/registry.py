"""Query registry: name -> (Spark plan over a Workspace, DuckDB oracle SQL).

Every registered query reads the driver's tables (directly or through the
fixture views derived from them) in full.  The oracle is an independent
SQL statement over the same parquet tables; ``None`` marks queries that
SQL cannot state and that are checked in our tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainscope.sources.fixtures import Workspace, oracle_ctes

QUERIES: dict[str, tuple[Callable[[Workspace], DataFrame], Callable[[], str] | None]] = {}

# Query results render date and timestamp columns as ISO text on both sides
# (Spark CAST(... AS STRING) and DuckDB CAST(... AS VARCHAR) print the same),
# so a comparison never depends on how a client library maps DATE/TIMESTAMP
# values.  Operators keep the typed columns.  TEMPORAL_OUT (below) lists the
# temporal output columns of each oracle.


def query(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


def render_oracle(name: str) -> str | None:
    """The oracle SQL, its temporal output columns cast to text."""
    oracle = QUERIES[name][1]
    if oracle is None:
        return None
    sql = oracle()
    cols = TEMPORAL_OUT.get(name)
    if not cols:
        return sql
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS _q"


TEMPORAL_OUT: dict[str, list[str]] = {
    **{q: ["check_day"] for q in ["monitor_check", "monitor_file_events", "monitor_package_events",
                                   "monitor_risk_events", "manifest_drift", "monitor_recent_events",
                                   "monitor_stream", "monitor_init_check"]},
    "monitor_status": ["last_check"],
    **{q: ["day"] for q in ["posture_snapshots", "latest_snapshots", "posture_compare", "posture_high_risk", "posture_compare_summary"]},
    "posture_trend": ["period_start", "period_end"],
    **{q: ["window_start"] for q in ["posture_windows", "posture_windows_stream"]},
}


def with_fixtures(fixtures: list[str], ctes: list[tuple[str, str]], select: str) -> str:
    """WITH <fixture CTEs> <query CTEs> <select> in DuckDB form."""
    allc = oracle_ctes(fixtures) + list(ctes)
    if not allc:
        return select
    return "WITH " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in allc) + "\n" + select


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = QUERIES[name][0](Workspace.of(spark, sf_dir))
    temporal = [f.name for f in df.schema.fields
                if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    for c in temporal:
        df = df.withColumn(c, df[c].cast("string"))
    return df


def load_all() -> None:
    """Import every module that registers queries."""
    from chainscope.plans import (catalog_queries, history_queries, inventory_queries, risk_queries,  # noqa: F401
                                  fingerprint_queries, govern_queries, sbom_queries, scan_queries,
                                  trust_queries)
