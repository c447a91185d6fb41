"""Benchmark decontamination by spaced-seed hashing.

A seed looks at ``span`` consecutive words (12; 8 for shorter items) in four
blocks.  Each of six fixed masks ignores two of the blocks and hashes the
words of the other two, so two passages that differ in any two words of a
span, by substitution, still agree under at least one mask.  Benchmark seeds
are looked up among the training text's; each hit fixes an item and a shift,
along which words are then compared one by one.  A document is contaminated
by an item if, at some shift, ``overlap`` consecutive words (all words of a
shorter item) agree in at least ``share`` of their places.

Items too short for a seed match exactly: those of ``EXACT`` words or more
wherever their whole word sequence stands, shorter ones only where they are a
document's whole text, since such phrases stand in any text.

Benchmark items are read in blocks of bounded size (``BLOCK_WORDS``), whose
index goes to the tasks, ``TOGETHER`` of them in a pass; the training text is
never shuffled, and a larger benchmark means more passes over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.store import apart, checkpointed

#: The pairs of blocks that a mask keeps.
MASKS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: Spans: of most items, and of those with fewer words.
SPANS = (12, 8)
#: Benchmark words in one index: 6 seeds of 16 bytes each a word.
BLOCK_WORDS = 500_000
#: Indexes that a pass over the text holds at once.
TOGETHER = 4
#: Words from which a short item is looked for inside longer texts.
EXACT = 5
_FILTER = 1 << 22


def seeds(hashes: np.ndarray, span: int, mask: int) -> np.ndarray:
    """A mask's hash of the span from each word on."""
    size = span // 4
    block = words.windows(hashes, size)
    out = np.zeros(len(hashes), np.uint64)
    n = max(0, len(hashes) - span + 1)
    a, b = (k * size for k in MASKS[mask])
    out[:n] = words.mix(words.mix(block[a:a + n] + np.uint64(span * 8 + mask)) + block[b:b + n] * words.STEP)
    return out


class Index:
    """Seeds of a block of benchmark items, sorted, with the words to verify."""

    def __init__(self, ids: list[int | None], texts: list[str], least: int) -> None:
        w = words.words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.first, self.hashes = ids, w.first, w.hashes
        count = np.diff(w.first)
        #: Of short items, by length: the hashes of their sequences, sorted, and the items.
        self.short = {}
        for n in np.unique(count[(count > 0) & (count < max(least, SPANS[1]))]).tolist():
            item = np.flatnonzero(count == n)
            key = words.windows(w.hashes, n)[w.first[item]]
            order = np.argsort(key, kind="stable")
            self.short[n] = key[order], item[order]
        self.keys, self.item, self.place = {}, {}, {}
        self.filter = {}
        for span, low, high in ((SPANS[0], SPANS[0], 1 << 62), (SPANS[1], max(least, SPANS[1]), SPANS[0])):
            use = (count >= low) & (count < high)
            at = np.flatnonzero((w.room() >= span) & np.repeat(use, count))
            row = w.rows()[at]
            for mask in range(len(MASKS)):
                if len(at):
                    key = seeds(w.hashes, span, mask)[at]
                    order = np.argsort(key, kind="stable")
                    self.keys[span, mask], self.item[span, mask] = key[order], row[order]
                    self.place[span, mask] = (at - w.first[row])[order]
                    bits = np.zeros(_FILTER, bool)
                    bits[(key & np.uint64(_FILTER - 1)).astype(np.int64)] = True
                    self.filter[span, mask] = bits

    def shifts(self, w: words.Words) -> np.ndarray:
        """Distinct (word of the slice where the item would begin, item) of all hits
        whose span lies in one row."""
        room, found = w.room(), []
        for (span, mask), keys in self.keys.items():
            hashed = seeds(w.hashes, span, mask)
            at = np.flatnonzero(self.filter[span, mask][(hashed & np.uint64(_FILTER - 1)).astype(np.int64)] & (room >= span))
            lo, hi = np.searchsorted(keys, hashed[at]), np.searchsorted(keys, hashed[at], "right")
            hit = np.flatnonzero(hi > lo)
            for part in np.array_split(hit, 1 + int((hi - lo)[hit].sum()) // (1 << 20)):
                n = (hi - lo)[part]
                k = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(np.unique(np.stack([np.repeat(at[part], n) - self.place[span, mask][k], self.item[span, mask][k], np.repeat(w.rows()[at[part]], n)], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def exact(index: Index, w: words.Words) -> Iterator[tuple[int, int, int]]:
    """(row, item, first word) of the first place of each short item in each text."""
    room, rows = w.room(), w.rows()
    for n, (keys, items) in index.short.items():
        at = np.flatnonzero(room >= n) if n >= EXACT else w.first[:-1][np.diff(w.first) == n]
        if not len(at):
            continue
        hashed = words.windows(w.hashes, n)[at]
        lo, hi = np.searchsorted(keys, hashed), np.searchsorted(keys, hashed, "right")
        met = set()
        for k in np.flatnonzero(hi > lo).tolist():
            row, begin = int(rows[at[k]]), int(at[k])
            for item in items[lo[k]:hi[k]].tolist():
                a = index.first[item]
                if (row, item) not in met and (w.hashes[begin:begin + n] == index.hashes[a:a + n]).all():
                    met.add((row, item))
                    yield row, item, begin - int(w.first[row])


def overlaps(index: Index, w: words.Words, overlap: int, share: float) -> Iterator[tuple[int, int | None, int, int, int]]:
    """(row, item id, first word, words, agreeing words) of each overlap."""
    for row, item, start in exact(index, w):
        n = int(index.first[item + 1] - index.first[item])
        yield row, index.ids[item], start, n, n
    for begin, item, row in index.shifts(w).tolist():
        a, b = index.first[item], index.first[item + 1]
        low, high = w.first[row], w.first[row + 1]
        start, stop = max(begin, low), min(begin + b - a, high)
        same = w.hashes[start:stop] == index.hashes[a + start - begin:a + stop - begin]
        size = min(overlap, b - a)
        if len(same) < size:
            continue
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[size:] - sums[:-size] >= share * size)
        if len(good):
            first, last = int(good[0]), int(good[-1]) + size
            yield row, index.ids[item], int(start - low) + first, last - first, int(sums[last] - sums[first])


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("agreeing", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], index, overlap: int, share: float, text: str, found: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, text):
            w = words.words(part.column(text), lower=True)
            hits = part.column(found).to_pylist()
            for row, item, start, length, agreeing in overlaps(index.value, w, overlap, share):
                hits[row].append({"item_id": item, "start": start, "length": length, "agreeing": agreeing})
            columns = [pa.array(hits, _HITS) if f.name == found else part.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, share: float = 0.8, least: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``hits``: for each benchmark item that the text
    overlaps with, the item's id, the first word, the number of words and of
    agreeing words of the overlap, in order of (start, item).

    Words are runs of non-blanks, A-Z lower-cased.  Items of fewer than ``least``
    words match exactly or not at all (see above); null and empty items and texts
    match nothing.  Items without id match like others, their hits have a null
    item_id.  Repeated rows have equal hits, repeated items a hit each.  A
    column named hits gives way, all others stay whatever their names.  An empty
    table gives no rows, an empty benchmark no hits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-int(items.agg(F.sum(F.size(F.split("text", "[ \t-\r]+")))).first()[0] or 0) // BLOCK_WORDS))
    names = [c for c in docs.columns if c != "hits"]
    text, found = apart(docs.columns, "_text", "_hits")
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(text),
                      F.expr("cast(array() as array<struct<item_id:long,start:long,length:long,agreeing:long>>)").alias(found))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()  # about BLOCK_WORDS words
        index = spark.sparkContext.broadcast(Index([r[0] for r in some], [r[1] for r in some], least))
        out = out.mapInArrow(partial(_scan, index=index, overlap=overlap, share=share, text=text, found=found, schema=to_arrow_schema(out.schema)), out.schema)
        if k % TOGETHER == TOGETHER - 1 and k + 1 < blocks:
            out = checkpointed(out, "decontaminated")  # its tasks are done with their indexes
    # by start, then item, those without id first
    return out.select(*[f"`{c}`" for c in names], F.array_sort(F.col(f"`{found}`"), lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1)
                      .when(a.item_id.eqNullSafe(b.item_id), 0).when(a.item_id.isNull(), -1).when(b.item_id.isNull(), 1)
                      .when(a.item_id < b.item_id, -1).otherwise(1)).alias("hits"))
