"""Words of whole texts as numpy arrays, for the operators that hash text.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  Those six separators are
single bytes in UTF-8, so words are cut on the bytes of an Arrow string
column without decoding it.  Hashes are 64-bit polynomial sums over random
byte values, so equal words hash alike in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Multiplier of the window hashes (odd; 3 modulo 8).
STEP = U64(0xD1B54A32D192ED03)
_SEED = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_TABLE[_SPACE] = 0
_HASH_BYTES = 1 << 20
_POWERS = np.ones(1, U64)

#: Texts are taken in slices of about this many bytes, which bounds a task's memory by its longest text.
SLICE_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 256), _BASE, U64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``limit`` text bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them (null: empty)."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # one longer than the rows

    def room(self) -> np.ndarray:
        """How many words of the same row are left from each word on, itself included."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.starts))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and the first word of each row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(rows), np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    cut[0] = cut[-1] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    at, block = 0, (ends - 1) // _HASH_BYTES
    for cut in [*(np.flatnonzero(np.diff(block)) + 1), len(starts)]:
        if cut > at:
            own = starts[at:cut] - starts[at]
            part = data[starts[at]:ends[cut - 1]]
            gaps = np.diff(own, append=len(part))
            place = np.arange(len(part)) - np.repeat(own, gaps)
            out[at:cut] = np.add.reduceat(_TABLE[part] * _powers(int(gaps.max()))[place], own)
        at = cut
    return mix(out + (ends - starts).astype(U64) * STEP)


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words of an Arrow string column; ``lower`` lower-cases A-Z first."""
    data, rows = utf8(column)
    if lower:
        data = _LOWER[data]
    starts, ends, first = spans(data, rows)
    return Words(data, starts, ends, _hash(data, starts, ends), first)


def ahead(values: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
    """At each index the value ``n`` further on, ``fill`` beyond the end."""
    out = np.full_like(values, fill)
    if n < len(values):
        out[:len(values) - n] = values[n:]
    return out


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of ``length`` words from each word on, by doubling
    (the last ``length - 1`` entries lack words and mean nothing)."""
    out, done, power = None, 0, hashes.copy()  # power: windows of 2^k words
    size, factor = 1, STEP
    left = length
    while left:
        if left & 1:
            if out is None:
                out, done = power.copy(), size
            else:  # prepend this power's window to what is gathered so far
                out = power * _step(done) + ahead(out, size)
                done += size
        left >>= 1
        if left:
            power = power * factor + ahead(power, size)
            size *= 2
            factor = _step(size)
    return out


def _step(n: int) -> np.uint64:
    return U64(pow(int(STEP), n, 1 << 64))
