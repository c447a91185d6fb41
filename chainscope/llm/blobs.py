"""Packed rows for shuffles of many small numbers.

Hashes, row keys and positions travel as binary cells, one row for each
(flush of a task, bucket), instead of one row for each number: a row then
costs what its numbers cost.  A task combines what it has gathered before a
flush, so a value that many rows share crosses the network once a flush and
no bucket grows with a hot value's frequency.  Everything a row holds is a
function of the task's input, so a task that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a task gathers before it sends them on.
FLUSH = 1 << 20
SCHEMA = "bucket int, kind int, a binary, b binary, c binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def bucket_count(spark: SparkSession) -> int:
    """A bucket for each shuffle partition: they grow with the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and where each bucket begins in it."""
    order = np.argsort(buckets.astype(np.uint16 if n <= 1 << 16 else np.int32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=n))])


class Rows:
    """Collects rows of SCHEMA and gives them out as one Arrow batch."""

    def __init__(self) -> None:
        self.cells: list[tuple] = []

    def put(self, kind: int, buckets: np.ndarray, n: int, *arrays: np.ndarray) -> None:
        if not len(buckets):
            return
        order, at = split(buckets, n)
        arrays = [x[order] for x in arrays]
        for k in np.flatnonzero(np.diff(at)):
            cells = [x[at[k]:at[k + 1]].tobytes() for x in arrays]
            self.cells.append((int(k), kind, *cells, *[None] * (3 - len(cells))))

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.cells:
            columns = zip(*self.cells)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)
            self.cells = []


def by_bucket(df: DataFrame, *order: str) -> DataFrame:
    """Each bucket's rows side by side in a task of their own."""
    return df.repartitionById(bucket_count(df.sparkSession), F.col("bucket")).sortWithinPartitions("bucket", *order)


def folded(batches: Iterator[pa.RecordBatch], fold: Callable[[int, list[tuple], Rows], None]) -> Iterator[pa.RecordBatch]:
    """Calls ``fold(bucket, rows, out)`` for each bucket of a task's sorted rows."""
    out, now, held = Rows(), None, []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "a", "b", "c"))):
            if row[0] != now and held:
                fold(now, held, out)
                held = []
                yield from out.take()
            now = row[0]
            held.append(row[1:])
    if held:
        fold(now, held, out)
    yield from out.take()


def joined(cells: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)
