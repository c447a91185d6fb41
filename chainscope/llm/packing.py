"""Packing of documents into sequences by the sum-of-squares rule.

A document's ids (its text's, then an end id) are cut at multiples of the
sequence length; full pieces are sequences of their own.  The rest goes to a
partly filled window.  A task keeps its windows in an array by fill level
and puts a rest of s ids into the level h (0: a new window) for which the
sum of the squared numbers of windows over all levels becomes least:

    moving a window from h to h + s changes the sum by
    2 (count[h + s] - count[h]) + 2, without the part of an empty or a full level.

This keeps windows spread over the levels, so that most rests find one that
they fill up.  When a task has no more rows (or its windows hold ``HELD``
ids) the emptiest windows are cut to fill the fullest.  What is left at the
task's end goes into sequences whose lengths are powers of two.  So no
sequence needs padding.  Tasks pack for themselves: sequence ids carry the
task's partition number, which stays the same when a task is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.tokens import SLICE, encoder

#: Ids that a task's open windows may hold before they are closed by cutting.
HELD = 1 << 23
_PIECE = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, the document's ids in all


class Packer:
    """Windows by fill level; ``closed`` collects finished ones."""

    def __init__(self, length: int) -> None:
        self.length, self.closed = length, []
        self.count = np.zeros(length + 1, np.int64)
        self.levels: dict[int, list[list[_PIECE]]] = {}
        self.held = 0

    def place(self, piece: _PIECE) -> None:
        size = len(piece[2])
        if size == self.length:
            self.closed.append([piece])
            return
        top = self.length - size
        change = 2 * self.count[size:] - 2 * self.count[:top + 1]
        change[0] += 1  # a new window: nothing leaves level 0
        change[1:] += 2
        change[top] -= 1  # a full window: nothing stays at the top
        change[1:][self.count[1:top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))  # of equals the fullest
        if level:
            window = self.levels[level].pop()
            self.count[level] -= 1
        else:
            window = []
        window.append(piece)
        self.held += size
        if level + size == self.length:
            self.closed.append(window)
            self.held -= self.length
        else:
            self.levels.setdefault(level + size, []).append(window)
            self.count[level + size] += 1

    def close(self) -> None:
        """Cuts the emptiest windows to fill the fullest; then powers of two."""
        windows = [w for level in sorted(self.levels) for w in self.levels[level]]
        self.levels, self.held = {}, 0
        self.count[:] = 0
        low, spare = 0, []
        while low < len(windows):
            window = windows.pop()
            room = self.length - sum(len(p[2]) for p in window)
            while room:
                if not spare:
                    if low >= len(windows):
                        break
                    spare, low = windows[low], low + 1
                doc, start, ids, total = spare.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            if room:
                windows, low, spare = [], 0, window
                break
            self.closed.append(window)
        if spare and low < len(windows):
            raise AssertionError("windows left over")
        spare = spare[::-1]
        left = sum(len(p[2]) for p in spare)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, start, ids, total = spare.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            self.closed.append(window)
            left -= size


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    packer, known, made = Packer(length), encoder(path), 0
    base = TaskContext.get().partitionId() << 40

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal made
        if not packer.closed:
            return
        cells = {f.name: [] for f in schema}
        for window in packer.closed:
            offset = 0
            for doc, start, ids, total in window:
                row = {"doc_id": doc, "start": start, "length": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                       "doc_tokens": total, "sequence_id": base + made, "offset": offset, "ids": ids}
                for name, column in cells.items():
                    column.append(row[name])
                offset += len(ids)
            made += 1
        packer.closed = []
        yield pa.RecordBatch.from_pydict({f.name: pa.array(cells[f.name], f.type) for f in schema}, schema=schema)

    for batch in batches:
        for part in words.slices(batch, limit=SLICE):
            flat, first = known.ids(part.column("text"))
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
                ids = np.append(flat[a:b], np.uint32(end))
                for at in range(0, len(ids), length):
                    packer.place((doc, at, ids[at:at + length].copy(), len(ids)))
                if packer.held > HELD:
                    packer.close()
            yield from out()
    packer.close()
    yield from out()


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, on request).

    ``tokenizer`` is the path of a tokenizers file that all executors have.
    Each document gives its text's ids and ``end``; null and empty texts give
    ``end`` alone.  Pieces of a sequence follow one another without gaps.  A
    sequence holds ``length`` ids or a power of two of them.  Repeated rows are
    packed each for itself, a null id stays null, columns beside id and text
    are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([*[(c, pa.int64()) for c in names], *[("ids", pa.list_(pa.int32()))] * with_ids])
    kinds = ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_pack, path=tokenizer, end=end, length=length, with_ids=with_ids, schema=schema), kinds)
