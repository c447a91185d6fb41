"""Runs of letters in whole texts, and how often each occurs.

Runs are found on the bytes of an Arrow string column.  Strings are compared
as strings (Arrow's dictionaries), never by hashes, so counts are exact.  A
task adds up what it has met and sends it on when that passes ``FLUSH`` rows:
a term that a third of all texts hold crosses the network once a flush.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Different rows that a task holds before it sends them on.
FLUSH = 1 << 19


def runs(member: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes that stay within a row."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(member) + 1, bool)
    edge[rows] = True
    before, after = np.empty(len(member), bool), np.empty(len(member), bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    before[edge[:-1]] = False
    after[edge[1:]] = False
    after[-1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """The spans of a byte array, which ascend without overlaps, as an Arrow array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if len(starts):
        cover = np.zeros(len(data) + 1, np.int8)
        cover[starts] += 1  # a place is the start of one span at most, and the end of one
        cover[ends] -= 1
        data = data[np.cumsum(cover[:-1], dtype=np.int8) > 0]
    else:
        data = data[:0]
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Tally:
    """Adds up rows of the same key columns and gives them out when there are many."""

    def __init__(self, keys: list[str], sums: list[str]) -> None:
        self.keys, self.sums, self.held, self.size = keys, sums, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(table)
        self.size += table.num_rows
        if self.size > FLUSH:
            self._combine()
            if self.size > FLUSH // 2:
                yield from self.rest()

    def _combine(self) -> None:
        if self.held:
            table = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([(x, "sum") for x in self.sums])
            table = table.select([*self.keys, *(f"{x}_sum" for x in self.sums)]).rename_columns([*self.keys, *self.sums])
            self.held, self.size = [table], table.num_rows

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._combine()
        for table in self.held:
            yield from table.to_batches(max_chunksize=1 << 16)
        self.held, self.size = [], 0
