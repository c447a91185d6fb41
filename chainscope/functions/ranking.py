"""Ranking inside groups without funnelling a hot group into one task.

``row_number() over (partition by g order by k)`` sends every row of a
group to one task; a group that holds a third of the data then becomes
one third of the job on one core.  ``group_rank`` takes a natural sub-key
instead, columns by which the order begins (a severity and a file, a score
and the first letters of a name), and

1. numbers rows inside each (group, sub-key);
2. counts rows of each (group, sub-key), combined before the shuffle, and
   prefix-sums the counts in the group: one row a sub-key, not one a row;
3. adds the two, by a join that keeps null groups and null sub-keys.

The sub-key comes from the row itself, so both branches agree whatever the
partitioning, and nothing runs while the plan is built.

Small top-k per group does not need this: ``row_number() <= k`` gets a
per-partition group limit before its shuffle (``top_k_per_group``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_rank(df: DataFrame, group_cols: list[str], order: list[Column], name: str = "rank",
               lead: list[tuple[Column, bool]] | None = None) -> DataFrame:
    """``row_number`` over ``order`` in each group.

    ``lead`` lists (column, descending) of the sub-key: sorting by it and
    then by ``order`` must be the same as sorting by ``order``.  Without it
    a plain window numbers the rows.
    """
    if not lead:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)).cast("bigint"))
    keys = [f"_k{i}" for i in range(len(lead))]
    tagged = df.withColumns({k: c for k, (c, _) in zip(keys, lead)})
    inside = Window.partitionBy(*group_cols, *keys).orderBy(*order)
    before = Window.partitionBy(*group_cols).orderBy(*[F.col(k).desc() if down else F.col(k) for k, (_, down) in zip(keys, lead)])
    counts = tagged.groupBy(*group_cols, *keys).agg(F.count("*").alias("_n"))
    both = [*group_cols, *keys]
    counts = counts.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(both)], (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    numbered = tagged.withColumn("_at", F.row_number().over(inside))
    on = reduce(lambda a, b: a & b, [numbered[c].eqNullSafe(counts[f"_j{i}"]) for i, c in enumerate(both)])
    return (numbered.join(counts, on).withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint"))
            .drop("_before", "_at", *keys, *[f"_j{i}" for i in range(len(both))]))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)
