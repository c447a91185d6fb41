"""Parallelism of CPU-heavy work.

Whether a join side is small enough to broadcast is left to Spark, which knows
its size in bytes at run time (adaptive execution); constant catalogues (rules,
license classes, popular names) are fixed-size by construction and are
broadcast directly by the operators that own them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _splits(df: DataFrame) -> int:
    """About how many tasks the scans below ``df`` start, from the files' number
    and the plan's statistics; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(len(df.inputFiles()), size // split)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    Input splits follow storage (a single-row-group parquet file is one
    task), and a broadcast join keeps the partitioning of its streamed
    side.  When few files and bytes are read the rows are hashed by their
    keys (near-unique row identity, so no hot partition) over the cores; a
    large input already has more splits and is left as it is, so no shuffle is
    added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not keys or _splits(df) >= cores:
        return df
    return df.repartition(cores * 4, *keys)
