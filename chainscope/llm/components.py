"""Connected components by alternating large and small stars.

Each round joins a written edge table with its own minima, so no task holds
a component, a hot centre is only a join key (which adaptive execution can
split), and rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chainscope.llm.store import checkpointed


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    seen = Observation(uuid.uuid4().hex)
    noted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    table = checkpointed(noted, name)
    return table, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; the root is the component's least
    node.  Loops, repeated and null-ended edges are allowed and mean nothing."""
    now, state = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                          .where((F.col(a) != F.col(b))).distinct(), "edges")
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = now.select(F.col("v").alias("k"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "k"), "k")
        # w > k: w hangs on the least neighbour of k; k itself does so too
        star = large.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        star = checkpointed(star.where("u > v").distinct(), "star")
        low = checkpointed(star.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before = state
        now, state = _written(small.where("u > v").distinct(), "edges")
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
