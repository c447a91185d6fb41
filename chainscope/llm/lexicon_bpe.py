"""BPE ids by a lexicon of frequent words, and text from ids.

For tokenizers of the word kind: text is normalised (NFC, blanks, lower case)
and cut into pieces, and each piece is merged by itself.  Pieces are counted
over all texts; the most frequent are compiled, with their ids, into a minimal
acyclic transducer.  Its edges carry numbers that add up along a path to the
piece's place, under which the ids stand (``automaton.py`` says why numbers).
The compiled lexicon is a file that Spark sends to every executor once; Python
workers map it into memory and share its pages.

A slice's pieces go through the transducer side by side: at each step numpy
takes one byte of all pieces that are that long.  A state has a bit for each
byte it accepts, and the rank of a bit is the edge's place, so a step is a
lookup and a population count.  Pieces that the lexicon doesn't hold are merged
exactly, pair of least rank first and leftmost among equals, a slice's different
ones side by side.  Results are the same whatever the lexicon holds.

Texts with characters beyond U+024F or controls, and those that hold a special
token's text, are normalised and cut by the tokenizers library; lookup and
merging are the same for them.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import terms, tokens, words
from chainscope.llm.automaton import Automaton
from chainscope.llm.store import checkpointed, shared_folder

#: Pieces in the lexicon (bounds the one task that compiles it, and the file).
LEXICON = 1 << 16
#: Symbols of a piece beyond which merging uses a heap.
_LONG = 32
_MAGIC = b"BPELEX01"
_CUT = SimpleNamespace(spaced=False)
_NEVER = np.int32((1 << 31) - 1)


class Vocabulary:
    """What a tokenizer file says: ids of bytes, ranked merges, special tokens, the ids' strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, suffix = config["model"], config["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        # byte-level alphabets print bytes as characters; those that are no printable Latin-1 follow U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        printed = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.path, self.byte_of = path, {c: b for b, c in printed.items()}
        self.inner = np.array([ids[printed[b]] for b in range(256)], np.int32)
        self.last = np.array([ids[printed[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        keys = left << 32 | right
        order = np.argsort(keys)
        #: Pairs that merge, ascending; each one's rank, and the id it makes.
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.strings = {i: s for s, i in {**ids, **self.special}.items()}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def by_pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, _NEVER for those that don't merge."""
        wanted = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], _NEVER)

    def merge(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each piece's begin: pairs
        are merged by rank, leftmost first."""
        sizes = np.array([len(p) for p in found], np.int64)
        made, counts = [], np.zeros(len(found), np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size > _LONG:
                rows = [self._merge_long(found[k]) for k in own.tolist()]
                counts[own] = [len(r) for r in rows]
                made.append((own, np.concatenate(rows)))
            elif size:
                raw = np.frombuffer(b"".join(found[k] for k in own.tolist()), np.uint8).reshape(len(own), size)
                ids = self._merge_alike(np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], 1))
                counts[own] = (ids >= 0).sum(1)
                made.append((own, ids[ids >= 0]))
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.int64)
        for own, ids in made:
            ends = np.cumsum(counts[own])
            out[np.repeat(at[own] - ends + counts[own], counts[own]) + np.arange(len(ids))] = ids
        return out, at

    def _merge_alike(self, ids: np.ndarray) -> np.ndarray:
        """Merges rows of equally many ids; what a row has less of in the end is -1."""
        ids = ids.copy()
        rank = self._ranked(ids[:, :-1], ids[:, 1:])
        live, width = np.arange(len(ids)), ids.shape[1]
        while len(live) and width > 1:
            at = rank[live].argmin(1)  # the first of the least
            on = rank[live, at] < _NEVER
            live, at = live[on], at[on]
            if not len(live):
                break
            pair = ids[live, at].astype(np.int64) << 32 | ids[live, at + 1]
            new = self.made[np.searchsorted(self.keys, pair)]
            shift = np.arange(width - 1)
            own = np.take_along_axis(ids[live], shift + (shift > at[:, None]), 1)
            own[np.arange(len(live)), at] = new
            ids[live, :-1], ids[live, -1] = own, -1
            kept = np.take_along_axis(rank[live], shift[:-1] + (shift[:-1] > at[:, None]), 1) if width > 2 else rank[live][:, :0]
            rank[live, :-1], rank[live, -1] = kept, _NEVER
            row = np.arange(len(live))
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 2)
            left = np.where(at > 0, self._ranked(own[row, before], new), rank[live, 0])
            rank[live, at] = np.where(at + 1 < width - 1, self._ranked(new, own[row, after]), _NEVER)
            rank[live[at > 0], before[at > 0]] = left[at > 0]
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, with a heap."""
        ids = [*self.inner[np.frombuffer(piece[:-1], np.uint8)].tolist(), int(self.last[piece[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*found, k, k + 1, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (found := self.by_pair.get(ids[k] << 32 | ids[k + 1]))]
        heap = [(rank, a, b, new, left, right) for rank, new, a, b, left, right in heap]
        heapq.heapify(heap)
        while heap:
            _, a, b, new, left, right = heapq.heappop(heap)
            if ids[a] != left or after[a] != b or ids[b] != right:
                continue  # one of them was merged meanwhile
            ids[a], ids[b], after[a] = new, -1, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (found := self.by_pair.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (found[0], x, y, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_library(known: Vocabulary, text: str) -> list[bytes]:
    """Pieces of a text by the library's normaliser and cutter; special tokens are pieces of their own."""
    out = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(known.special, key=len, reverse=True))) + ")", text) if known.special else [text]:
        if part in known.special:
            out.append(part.encode())
        elif part:
            cut = known.library.pre_tokenizer.pre_tokenize_str(known.library.normalizer.normalize_str(part))
            out += [bytes(known.byte_of[c] for c in piece) for piece, _ in cut]
    return out


def pieces(column: pa.Array, known: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in order, as binary cells, and the first of each text."""
    data, rows = words.utf8(column)
    raw = data.tobytes()
    text = raw.decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) != len(data):
        rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
    kinds = tokens._CLASS[np.minimum(points, tokens._LIMIT)]
    odd = np.diff(np.concatenate([[0], np.cumsum(kinds == tokens._ODD)])[rows]) > 0
    for special in known.special:
        at = text.find(special)
        while at >= 0:
            odd[np.searchsorted(rows, at, "right") - 1] = True
            at = text.find(special, at + 1)
    if odd.any():
        kinds = np.where(np.repeat(odd, np.diff(rows)), np.uint8(tokens._ODD), kinds)
    points = tokens._LOWER[np.minimum(points, tokens._LIMIT - 1)]
    starts, ends = tokens.Encoder._pieces(_CUT, points, kinds, rows)
    first = np.searchsorted(starts, rows)
    wide = points >= 0x80
    at = np.concatenate([[0], np.cumsum(1 + wide)])  # below U+0250 a character has one byte or two
    lowered = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    cells = terms.strings(lowered, at[starts], at[ends], pa.binary())
    if odd.any():
        whole = np.flatnonzero(odd)
        parts, sizes, done = [], np.diff(first), 0
        for r in whole.tolist():
            own = _by_library(known, column[r].as_py())
            parts += [cells.slice(done, int(first[r]) - done), pa.array(own, pa.binary())]
            done, sizes[r] = int(first[r]), len(own)
        cells, first = pa.concat_arrays([*parts, cells.slice(done)]), np.concatenate([[0], np.cumsum(sizes)])
    return cells, first


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known, tally = vocabulary(path), terms.Tally(["piece"], ["n"])
    for batch in batches:
        for part in words.slices(batch, limit=tokens.SLICE):
            counts = pieces(part.column("text"), known)[0].value_counts()
            yield from tally.add(pa.table({"piece": counts.field("values"), "n": counts.field("counts")}))
    yield from tally.rest()


def compiled(order: list[bytes], flat: np.ndarray, at: np.ndarray) -> bytes:
    """A lexicon as bytes: magic, the arrays' sizes, the arrays (see ``Lexicon``).
    ``order`` ascends; its ids stand one after the other, from ``at`` on."""
    a = Automaton(order)
    n = len(a.final)
    bits = np.zeros((n, 256), np.uint8)
    bits[a.edge >> 8, a.symbol] = 1
    mask = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    rank = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(np.bitwise_count(mask)[:, :3], axis=1)], 1) + a.first[:-1, None]
    arrays = [mask.astype("<u8").tobytes(), rank.astype("<i8").tobytes(), a.target.astype("<i8").tobytes(), a.before.astype("<i8").tobytes(),
              at.astype("<i8").tobytes(), flat.astype("<i8").tobytes(), a.final.astype(np.uint8).tobytes()]
    return _MAGIC + np.array([n, a.start, len(a.symbol), len(order), len(flat)], "<i8").tobytes() + b"".join(arrays)


class Lexicon:
    """A compiled lexicon over any buffer, such as a mapped file."""

    def __init__(self, content: bytes | mmap.mmap) -> None:
        if content[:8] != _MAGIC:
            raise ValueError("not a lexicon")
        n, self.start, edges, self.size, ids = np.frombuffer(content, "<i8", 5, 8).tolist()
        place = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(content, kind, count, place)
            place += out.nbytes
            return out

        self.mask, self.rank = take("<u8", 4 * n), take("<i8", 4 * n)
        self.target, self.before = take("<i8", edges), take("<i8", edges)
        self.at, self.ids, self.final = take("<i8", self.size + 1), take("<i8", ids), take("u1", n)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span of bytes, -1 for those not held."""
        out = np.full(len(starts), -1)
        if not self.size:
            return out
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        sizes = (ends - starts)[order]
        place, state, number = starts[order], np.full(len(order), self.start), np.zeros(len(order), np.int64)
        live = np.arange(len(order))
        k = 0
        while len(live):
            over = np.searchsorted(-sizes[live], -k, "left")  # those that end here
            done = live[over:]
            done = done[self.final[state[done]] > 0]
            out[order[done]] = number[done]
            live = live[:over]
            byte = data[place[live] + k]
            cell = state[live] * 4 + (byte >> 6)
            bit = np.uint64(1) << (byte & 63).astype(np.uint64)
            mask = self.mask[cell]
            on = (mask & bit) != 0
            live, cell, bit, mask = live[on], cell[on], bit[on], mask[on]
            edge = self.rank[cell] + np.bitwise_count(mask & (bit - np.uint64(1)))
            state[live] = self.target[edge]
            number[live] += self.before[edge]
            k += 1
        return out


def _bytes(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its offsets in them."""
    _, offsets, data = cells.buffers()
    at = np.frombuffer(offsets, np.int32)[cells.offset:cells.offset + len(cells) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    """ids(column) gives all texts' ids and where each text's begin."""

    def __init__(self, known: Vocabulary, lexicon: Lexicon) -> None:
        self.known, self.lexicon = known, lexicon

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cells, first = pieces(column, self.known)
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
        data, at = _bytes(cells)
        number = self.lexicon.find(data, at[:-1], at[1:])
        missed = np.flatnonzero(number < 0)
        pool, offsets = self.lexicon.ids, self.lexicon.at
        if len(missed):
            coded = cells.take(pa.array(missed)).dictionary_encode()
            own, own_at = self.known.merge(coded.dictionary.to_pylist())
            pool, offsets = np.concatenate([pool, own]), np.concatenate([offsets, offsets[-1] + own_at[1:]])
            code = coded.indices.to_numpy()
            for text, i in self.known.special.items():  # a piece that is a special token's text is that token
                at = pc.index(coded.dictionary, text.encode()).as_py()
                if at >= 0:
                    code = np.where(code == at, len(coded.dictionary), code)
                    pool, offsets = np.append(pool, i), np.append(offsets, offsets[-1] + 1)
                    coded = pa.DictionaryArray.from_arrays(pa.array(code), pa.concat_arrays([coded.dictionary, pa.array([b""], pa.binary())]))
            number[missed] = self.lexicon.size + code
        sizes = offsets[number + 1] - offsets[number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = pool[np.repeat(offsets[number] - total[:-1], sizes) + np.arange(total[-1])]
        return flat, total[first]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    coder = Encoder(vocabulary(path), _mapped(name))
    for batch in batches:
        for part in words.slices(batch, limit=tokens.SLICE):
            flat, first = coder.ids(part.column("text"))
            ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, "ids"])


def _most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The pieces of the most frequent bands of n (a sixty-fourth of a doubling
    each) that are ``size`` together or fewer.  A few thousand bands are counted;
    no task meets more pieces than are taken."""
    band = F.floor(F.log2("n") * 64).cast("int")
    left, cut = size, None
    for row in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        if row["count"] > left:
            break
        left, cut = left - row["count"], row.band
    return counts.where(band >= cut if cut is not None else F.lit(False)).select("piece")


def lexicon_file(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> str:
    """Compiles the most frequent pieces of all texts (column text), ``size`` at
    most, and sends the file to the executors; gives its name there."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(partial(_count, path=tokenizer), "piece binary, n long")
    counts = checkpointed(counts.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    top = _most_frequent(counts, size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer)
        found = sorted(p for batch in batches for p in batch.column("piece").to_pylist() if p is not None and p.decode("utf-8", "replace") not in known.special)
        content = compiled(found, *known.merge(found))
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    folder = shared_folder(spark, "lexicon")
    top = top.unionByName(spark.range(1).select(F.lit(None).cast("binary").alias("piece")))  # a task and a file even if there are no pieces
    top.coalesce(1).mapInArrow(build, "content binary").select(F.col("content").cast("string").alias("value")).write.option("compression", "none").text(folder)
    path = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).orderBy(F.desc("length")).select("path").head()[0]
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, tokenizer: str, size: int = LEXICON, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids (array<int>) of each row's whole text, as the
    tokenizers library encodes it without adding special tokens; the special
    tokens' own texts become their ids.

    Null and empty texts have no ids; rows that repeat are encoded each; an empty
    table gives none.  ``keep`` may hold any column but one named ids or text; an
    input column named ids is not read.
    """
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    name = lexicon_file(rows, tokenizer, size)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>"])
    return rows.mapInArrow(partial(_encoded, path=tokenizer, name=name), schema)


def _joined(ids: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's strings with a blank after each, without the last blank: bytes and offsets."""
    data, place = table
    sizes = place[ids + 1] - place[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(place[ids] - total[:-1], sizes) + np.arange(total[-1])]
    ends = total[at]
    if len(ids):
        last = np.unique(ends[1:][np.diff(at) > 0]) - 1
        out = np.delete(out, last)
        ends = ends - np.searchsorted(last, ends, "left")
    return out, ends


@lru_cache(maxsize=2)
def _strings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids' strings, each with a blank after it; ids that the vocabulary lacks have none."""
    known = vocabulary(path).strings
    cells = [(known[i] + " ").encode() if i in known else b"" for i in range(max(known) + 2)]
    return np.frombuffer(b"".join(cells), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in cells])])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = _strings(path)
    absent = len(table[1]) - 2
    for batch in batches:
        sizes = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // (1 << 17)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.where((ids < 0) | (ids >= absent), absent, ids)
                at = np.concatenate([[0], np.cumsum(sizes[a:b])])
                data, offsets = _joined(ids, at, table)
                text = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """All columns and ``decoded``, the text of the column ids as the library's
    decode gives it with special tokens kept (a tokenizer without a decoder:
    the ids' strings joined by blanks).

    Null or empty ids give an empty text; ids that the vocabulary lacks are
    left out.  An input column named decoded is replaced.
    """
    rows = rows.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string"])
    return rows.mapInArrow(partial(_decoded, path=tokenizer), schema)
