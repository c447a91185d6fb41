"""Token ids of a corpus as bit-packed files.

A file is a row of sections, each ended by a newline byte (so that Spark's
text writer, with its commit protocol, can write it to any store):

* blocks: ``BLOCK`` ids each (the last may have fewer), every id in the
  least number of bits that the vocabulary needs, lowest bits first;
* a footer: little-endian int64 numbers -- bits of an id, ids, blocks,
  documents, then the blocks' byte offsets, the documents' ids and the place
  of each document's first id -- and last the footer's length and ``MAGIC``.

Files follow one another in ascending order of document ids, as their names
do.  Id number i of a file starts at bit (i mod BLOCK) * bits of its block,
so any span is read without the rest (``read_span``) and a block is unpacked
by numpy at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.store import checkpointed
from chainscope.llm.tokens import SLICE, encoder

BLOCK = 1 << 16
#: Text of a file; its ids take about half as many bytes, far below what a row may hold.
FILE_BYTES = 1 << 28
MAGIC = b"BITIDS01"
#: Stands for a null document id in a footer.
NO_ID = -(1 << 63)


def bits_for(size: int) -> int:
    """Bits that hold ids 0..size-1."""
    return max(1, (size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(block: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids of a block from its ``first`` on."""
    if not count:
        return np.zeros(0, np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    base = int(at[0] >> 3)
    raw = bytes(block[base:int(at[-1] >> 3) + 8]) + bytes(8)
    spans = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return ((spans[(at >> 3) - base] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def footer(content: bytes | memoryview) -> dict:
    """What a file's footer says."""
    content = memoryview(content)
    if bytes(content[-9:-1]) != MAGIC:
        raise ValueError("not a token file, or cut off")
    size = int(np.frombuffer(content[-17:-9], "<i8")[0])
    numbers = np.frombuffer(content[-17 - size:-17], "<i8")
    bits, ids, blocks, docs = (int(x) for x in numbers[:4])
    rest = numbers[4:]
    return {"bits": bits, "ids": ids, "blocks": rest[:blocks], "docs": rest[blocks:blocks + docs], "starts": rest[blocks + docs:blocks + 2 * docs]}


def read_span(content: bytes | memoryview, info: dict, first: int, count: int) -> np.ndarray:
    """Ids first..first+count-1 of a file; only the blocks they lie in are touched."""
    content, out = memoryview(content), []
    while count > 0:
        block, inside = divmod(first, BLOCK)
        n = min(count, BLOCK - inside)
        start = int(info["blocks"][block])
        out.append(unpacked(content[start:start + (BLOCK * info["bits"] + 7) // 8], info["bits"], inside, n))
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_SECTION = pa.schema([("section", pa.binary())])


def _sections(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Blocks and the footer of a task's documents, in order."""
    known = encoder(path)
    bits = bits_for(max(known.size, end + 1))
    held, size, place, blocks, docs, starts, ids = [], 0, 0, [], [], [], 0

    def emit(section: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], schema=_SECTION)

    for batch in batches:
        for part in words.slices(batch, limit=SLICE):
            flat, first = known.ids(part.column("text"))
            rows = np.arange(part.num_rows)
            docs += [NO_ID if x is None else x for x in part.column("doc_id").to_pylist()]
            starts.append(ids + first[:-1] + rows)
            flat = np.insert(flat, first[1:], np.uint32(end))
            ids += len(flat)
            held.append(flat)
            size += len(flat)
            if size >= BLOCK:
                flat = np.concatenate(held)
                for a in range(0, size - size % BLOCK, BLOCK):
                    section = packed(flat[a:a + BLOCK], bits)
                    blocks.append(place)
                    place += len(section) + 1
                    yield emit(section)
                held, size = [flat[size - size % BLOCK:].copy()], size % BLOCK
    if docs:
        if size:
            section = packed(np.concatenate(held), bits)
            blocks.append(place)
            yield emit(section)
        numbers = np.concatenate([[bits, ids, len(blocks), len(docs)], blocks, docs, np.concatenate(starts)]).astype("<i8").tobytes()
        yield emit(numbers + np.array([len(numbers)], "<i8").tobytes() + MAGIC)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each document's ids and ``end`` to ``folder``, a file for each range
    of document ids, in ascending order (null ids first; equal ids by the hash of
    the whole text).  A file holds about ``FILE_BYTES`` of text, or less where the
    session's shuffle partitions are more than that makes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    sections = placed.mapInArrow(partial(_sections, path=tokenizer, end=end), "section binary")
    sections.select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(folder)


_READ = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            content = memoryview(content.as_buffer())
            if not len(content):
                continue
            info = footer(content)
            ends = np.append(info["starts"][1:], info["ids"])
            step = 1024
            for a in range(0, len(ends), step):
                starts, stops = info["starts"][a:a + step], ends[a:a + step]
                flat = read_span(content, info, int(starts[0]), int(stops[-1] - starts[0]))
                parts = [flat[i:j] for i, j in zip((starts - starts[0]).tolist(), (stops - starts[0]).tolist())]
                docs = info["docs"][a:a + step]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(parts)), pa.array(docs, mask=docs == NO_ID), pa.array(starts), pa.array(stops - starts),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                    pa.array([x.astype(np.int32) for x in parts] if with_ids else [None] * len(parts), pa.list_(pa.int32()))], schema=_READ)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, on
    request, ids, one row for each document of a folder of token files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    read = files.select("path", "content").mapInArrow(partial(_read, with_ids=with_ids), "path string, doc_id long, place long, n_tokens long, ids_crc32 long, ids array<int>")
    read = checkpointed(read, "read")  # so that files are read once
    sizes = read.groupBy("path").agg(F.max(F.col("place") + F.col("n_tokens")).alias("ids"))
    number = F.regexp_extract("path", "part-([0-9]+)", 1).cast("long")  # names of over five digits do not sort as text
    before = sizes.select("path", (F.sum("ids").over(Window.orderBy(number)) - F.col("ids")).alias("before"))  # a row for each file
    out = read.join(before, "path").withColumn("start", F.col("before") + F.col("place"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids to ``folder`` and reads the files back.

    Null and empty texts give the end id alone.  Null ids come first; rows that
    repeat are written each.  Columns beside id and text are not read.  An empty
    table writes no documents and reads none.
    """
    write_tokens(docs, folder, tokenizer, end, id_col, text_col)
    return read_tokens(docs.sparkSession, folder, with_ids)
