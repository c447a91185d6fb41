"""Array expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accumulated(values: Column) -> Column:
    """Running sums; the array grows in the accumulator and is copied at each step."""
    zero = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        return F.struct(F.concat(acc["out"], F.array(total)).alias("out"), total.alias("sum"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def running_sum(values: Column) -> Column:
    """The sums of an array's first 1, 2, ... n values.

    Sums run inside blocks of about the square root of n values and over the
    blocks' totals, so what an accumulator copies stays that short and the work
    is n lambda calls and n^1.5 copied elements, not n^2.  An empty array gives
    an empty array.
    """
    size = F.size(values)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    blocks = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda b: _accumulated(F.slice(values, b * block + 1, block))))

    def flat(inner: Column) -> Column:
        ends = _accumulated(F.transform(inner, lambda x: F.element_at(x, -1)))
        start = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1))
        return F.flatten(F.zip_with(inner, start, lambda own, at: F.transform(own, lambda x: x + at)))

    return F.when(size > 0, flat(blocks)).otherwise(F.array().cast("array<long>"))
