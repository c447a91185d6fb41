"""Substring deduplication by level-wise doubling.

A window of ``window`` words that starts in two places is a repeat, and
each word that a repeat covers is removed.  Comparing all windows at full
length would shuffle one hash a word.  Instead lengths are taken in levels,
each twice the one before (18 and 35 words for a window of 35):

1. A window can only be repeated if the shorter windows in it are.  Of the
   shorter windows inside each candidate the one with the least hash is its
   anchor: equal windows have equal anchors, so it is enough to look for
   anchors that are repeated, about a tenth of all positions.
2. Only windows whose anchor is repeated go on to twice the length.
3. At full length a window is its own anchor: what is repeated there is
   removed.

Hashes go to buckets as packed rows (``blobs``): a task sends a hash once a
flush however often it meets it, and answers what is repeated within the
flush itself.  So a passage that a third of all documents share loads no
bucket.  A bucket's answers (row key, position) go back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import blobs, words

#: The shortest level is at least this long; shorter windows repeat by chance.
SHORTEST = 16
_HASHES, _KNOWN, _ANSWERS = 0, 1, 2
_NONE = np.uint64(2**64 - 1)


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths by doubling up to ``window``: 35 gives 18, 35."""
    out = [window]
    while (half := -(-out[0] // 2)) >= shortest:
        out.insert(0, half)
    return out


def _slide(values: np.ndarray, n: int, least: bool, fill: np.uint64) -> np.ndarray:
    """Minimum (or maximum) of each run of ``n`` values from an index on."""
    pick = np.minimum if least else np.maximum
    out, done = values.copy(), 1
    while done < n:
        step = min(done, n - done)
        out, done = pick(out, words.ahead(out, step, fill)), done + step
    return out


def _anchors(hashes: np.ndarray, alive: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``length``-word windows, the least of them in each candidate window
    (0: no candidate)."""
    short = np.minimum(words.mix(words.windows(hashes, length)), _NONE - np.uint64(1)) | np.uint64(1)
    least = _slide(short, window - length + 1, True, _NONE)
    return short, np.where(alive, least, np.uint64(0))


def _chosen(short: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the anchor of a candidate window."""
    back = _slide(least[::-1], span, False, np.uint64(0))[::-1]
    return np.flatnonzero((back == short) & (back > 0))


def _alive(hashes: np.ndarray, room: np.ndarray, window: int, lengths: list[int], told: list[np.ndarray]) -> np.ndarray:
    """Windows that are still candidates after the levels that have answers."""
    alive = room >= window
    for length, answer in zip(lengths, told):
        short, least = _anchors(hashes, alive, window, length)
        flagged = np.full(len(short), _NONE)
        flagged[answer] = short[answer]
        alive = alive & (_slide(flagged, window - length + 1, True, _NONE) == least)
    return alive


class _Level:
    """Anchors of one level, sent to the buckets of their hashes."""

    def __init__(self, n: int, count: int) -> None:
        self.n, self.count, self.rows = n, count, blobs.Rows()
        self.held: list[tuple] = []
        self.size = 0

    def add(self, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, level: int) -> None:
        self.held.append((hashes, keys, (places << 4 | level).astype(np.int64)))
        self.size += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            hashes, keys, places = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            again = np.zeros(len(ranked), bool)
            again[1:] = ranked[1:] == ranked[:-1]
            many = again.copy()
            many[:-1] |= again[1:]
            known = ranked[many & ~again]
            self.rows.put(_KNOWN, (known % np.uint64(self.n)).astype(np.int64), self.n, known)
            told = np.sort(order[many])
            self.rows.put(_ANSWERS, np.mod(keys[told], self.n), self.n, keys[told], places[told])
            asked = np.sort(order[~many])
            self.rows.put(_HASHES, (hashes[asked] % np.uint64(self.n)).astype(np.int64), self.n, hashes[asked], keys[asked], places[asked])
            yield from self.rows.take()


def _answer(n: int, _bucket: int, rows: list[tuple], out: blobs.Rows) -> None:
    """Of a bucket's hashes, those that another flush has too."""
    told = [r for r in rows if r[0] == _ANSWERS]
    keys, places = [blobs.joined([r[1] for r in told], np.int64)], [blobs.joined([r[2] for r in told], np.int64)]
    asked = [r for r in rows if r[0] == _HASHES]
    hashes = blobs.joined([r[1] for r in asked], np.uint64)
    if len(hashes):
        pool = np.sort(np.concatenate([hashes, blobs.joined([r[1] for r in rows if r[0] == _KNOWN], np.uint64)]))
        twice = np.unique(pool[1:][pool[1:] == pool[:-1]])
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
            keys.append(blobs.joined([r[2] for r in asked], np.int64)[hit])
            places.append(blobs.joined([r[3] for r in asked], np.int64)[hit])
    keys, places = np.concatenate(keys), np.concatenate(places)
    out.put(_ANSWERS, np.mod(keys, n), n, keys, places)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch, words.Words]]:
    for part in words.slices(batch, "text"):
        yield part.column("_row").to_numpy(zero_copy_only=False), part, words.words(part.column("text"))


class _Told:
    """A bucket's answers, found again by row key."""

    def __init__(self) -> None:
        self.now, self.held = None, []
        self.keys = self.places = np.zeros(0, np.int64)

    def read(self, bucket: int, rows: list[tuple]) -> None:
        self.keys = blobs.joined([r[0] for r in rows], np.int64)
        self.places = blobs.joined([r[1] for r in rows], np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[order]

    def of(self, rows: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
        """Positions in a slice's words that have an answer at a level."""
        lo, hi = np.searchsorted(self.keys, rows), np.searchsorted(self.keys, rows, "right")
        counts = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        places = self.places[at]
        return (np.repeat(first[:-1], counts) + (places >> 4))[(places & 15) == level]


def _each(batches: Iterator[pa.RecordBatch], told: _Told) -> Iterator[tuple[np.ndarray, pa.RecordBatch, words.Words]]:
    """Slices of text rows, after the answers of their bucket have been read."""
    held, stale = [], False  # answers come before the texts of their bucket, and are put in order once
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(buckets) != 0)) + 1), len(kinds)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if buckets[a] != told.now:
                told.now, held, stale = buckets[a], [], True
            run = batch.slice(a, b - a)
            if kinds[a] == 0:
                held += zip(run.column("a").to_pylist(), run.column("b").to_pylist())
                stale = True
                continue
            if stale:
                told.read(told.now, held)
                stale = False
            yield from _texts(run)


def _ask(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int], level: int, n: int, answered: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of the windows that the levels before have left."""
    out, told = _Level(n, level), _Told()
    for rows, _, w in _each(batches, told) if answered else (x for b in batches for x in _texts(b)):
        before = [told.of(rows, w.first, k) for k in range(level)]
        alive = _alive(w.hashes, w.room(), window, lengths[:level], before)
        if not alive.any():
            continue
        short, least = _anchors(w.hashes, alive, window, lengths[level])
        at = _chosen(short, least, window - lengths[level] + 1)
        row = np.searchsorted(w.first, at, "right") - 1
        out.add(short[at], rows[row], at - w.first[row], level)
        for k, own in enumerate(before):  # answers that the next levels need again travel along
            row = np.searchsorted(w.first, own, "right") - 1
            if level + 1 < len(lengths):
                out.rows.put(_ANSWERS, np.mod(rows[row], n), n, rows[row], (own - w.first[row]) << 4 | k)
        if out.size >= blobs.FLUSH:
            yield from out.flush()
    yield from out.flush()
    yield from out.rows.take()


def _keep(batches: Iterator[pa.RecordBatch], window: int, level: int, schema: pa.Schema, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with the words that no repeated window covers."""
    told = _Told()
    for rows, part, w in _each(batches, told):
        covered = np.zeros(len(w.starts) + 1, np.int64)
        at = told.of(rows, w.first, level)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
        keep = np.cumsum(covered)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
        starts, ends, raw = w.starts[keep], w.ends[keep], w.data.tobytes()
        texts = []
        for a, b in zip(kept, kept[1:]):
            # runs of kept words that stand one space apart are cut out of the text in one piece
            s, e = starts[a:b], ends[a:b]
            if len(s):
                spaced = (s[1:] == e[:-1] + 1) & (w.data[np.minimum(e[:-1], len(w.data) - 1)] == 32)
                cut = np.flatnonzero(~spaced)
                texts.append(b" ".join([raw[i:j] for i, j in zip(s[np.concatenate([[0], cut + 1])].tolist(), e[np.concatenate([cut, [len(e) - 1]])].tolist())]))
            else:
                texts.append(b"")
        n = np.diff(w.first)
        own = {"n_words": n, "n_removed": n - np.diff(kept), "kept_text": texts,
               "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
        yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own and f.name not in columns else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_text (kept words
    joined by one space; left out with ``keep_text=False``) and its kept_sha256.

    Null and empty texts have no words: 0, 0 and the digest of the empty text.
    Rows that repeat, also with the same id, count as two places, so their
    windows are repeats.  Texts shorter than the window keep all words.  Other
    columns are left out, whatever their names.  A null id is kept as it is.
    """
    spark, lengths, n = docs.sparkSession, levels(window), blobs.bucket_count(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_row", F.xxhash64("doc_id", "text"))
    keyed = rows.select(F.pmod("_row", F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "doc_id", "text", "_row")

    def met(answers: DataFrame) -> DataFrame:
        nothing = {"doc_id": "long", "text": "string", "_row": "long"}
        told = answers.select("bucket", F.lit(0).alias("kind"), "a", "b", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
        return blobs.by_bucket(told.unionByName(keyed), "kind")

    answers = None
    for level in range(len(lengths)):
        source = rows if answers is None else met(answers)
        asked = source.mapInArrow(partial(_ask, window=window, lengths=lengths, level=level, n=n, answered=answers is not None), blobs.SCHEMA)
        answers = blobs.by_bucket(asked).mapInArrow(partial(_fold, n=n), blobs.SCHEMA)
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *[("kept_text", pa.string())] * keep_text, ("kept_sha256", pa.string())])
    text = "kept_text string, " if keep_text else ""
    return met(answers).mapInArrow(partial(_keep, window=window, level=len(lengths) - 1, schema=kind, columns=["doc_id"]), f"doc_id long, n_words long, n_removed long, {text}kept_sha256 string")


def _fold(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    return blobs.folded(batches, partial(_answer, n))
