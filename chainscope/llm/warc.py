"""WARC archives: a writer with revisit records, and a reader that verifies
boundaries as a chain.

Writer.  A record is its header, a blank line, the block and two newlines;
Spark's text writer puts down one record a row with the two newlines as its
separator, so its output is a WARC file, committed like any other.  Records
with equal payloads are written once: the one of the largest id is the
response, the others are revisits that refer to it.

Reader.  Spark splits the files at ``\\r\\n\\r\\nWARC/``, which ends every
record but may as well stand inside a payload.  Each task gives its pieces'
lengths, and prefix sums over the splits of a file give their offsets.  A
piece that parses as a record header is a candidate, whose length names its
successor's offset.  Pointer jumping from the file's start doubles the
number of steps each round and keeps the candidates that the chain reaches.
Pieces that it does not reach are payload of the record before and are put
back there.  A chain that does not end at the end of its file is cut off
where its last record would overrun, and ``complete`` tells so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chainscope.llm.store import checkpointed

_END = "\r\n\r\n"
_SEPARATOR = "\r\n\r\nWARC/"
_DATE = "2024-01-01T00:00:00Z"
_HEADER = re.compile(rb"1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")


def digest_of(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits in 32 characters of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        bits = F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 2), 40, "0")
        parts += [F.substring(F.lit(letters), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def _named(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))


def write_warc(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, least: int = 0) -> None:
    """Writes one record for each row to ``folder``.

    Of the rows with equal payloads of at least ``least`` bytes, those with the
    largest id are responses and the others revisits; rows with shorter payloads
    are all responses.  A null payload is written as an empty one, a null url as
    an empty one.  A row without id is a response unless another row with an id
    has its payload.  Newlines in urls become spaces.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", " ").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    winners = checkpointed(rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))
                           .where("n > 1").drop("n"), "winners")
    met = rows.join(winners, "digest", "left")  # by Spark's own size check: a merge would shuffle all payloads
    revisit = F.col("winner").isNotNull() & (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("winner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _named(F.col("id")), F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest_of(F.col("payload")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _named(F.col("winner")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(_END))
    met.select(F.concat(header, http, body).alias("value")).write.option("lineSep", _END).option("compression", "none").text(folder)


_PIECES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("raw", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's splits, in order, with their place in the split and, of
    those that begin with a record header, the record's length from there."""
    now, at = None, 0
    for batch in batches:
        places, sizes, lengths, raws = [], [], [], batch.column("value")
        for path, block, value in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), raws.to_pylist()):
            if (path, block) != now:
                now, at = (path, block), 0
            places.append(at)
            skip = 5 if at == 0 and block == 0 and value[:5] == b"WARC/" else 0  # the file's first magic
            sizes.append(len(value))
            found = _HEADER.match(value, skip)
            length = re.search(rb"(?i)^content-length:[ \t]*(\d+)[ \t]*\r$", found[1], re.M) if found else None
            lengths.append(found.end() - skip + int(length[1]) if length else None)
            at += len(value) + len(_SEPARATOR)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), raws], schema=_PIECES)


def reachable(links: DataFrame) -> DataFrame:
    """(path, at) of the candidates that a chain of (path, at, next) links reaches
    from offset 0, by pointer jumping: after k rounds these are a file's first
    2^k records, and links lead 2^k records on."""
    reached = checkpointed(links.where("at = 0").select("path", "at"), "reached")
    starts = links.select("path", F.col("at").alias("next"))
    jump = checkpointed(links.join(starts.hint("merge"), ["path", "next"], "left_semi").select("path", "at", "next"), "links")
    while True:
        seen = Observation(uuid.uuid4().hex)
        new = reached.join(jump.hint("merge"), ["path", "at"]).select("path", F.col("next").alias("at"))
        new = checkpointed(new.observe(seen, F.count(F.lit(1)).alias("n")), "reached")
        if not seen.get["n"]:
            return reached
        reached = reached.union(new)
        far = jump.select("path", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = checkpointed(jump.join(far.hint("merge"), ["path", "next"]).select("path", "at", F.col("far").alias("next")), "links")


_RECORDS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
                      ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()), ("complete", pa.bool_())])


def parse(raw: bytes, length: int) -> dict:
    """Fields of a record, from behind its ``WARC/`` on."""
    found = _HEADER.match(raw)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in found[1].decode("utf-8", "replace").split("\r\n"))}
    block = raw[found.end():length]
    http, cut, payload = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
    kind = fields.get("warc-type")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = kind == "revisit"
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": named if revisit else own, "payload_bytes": int(size[1]) if revisit and size else len(payload), "payload": None if revisit else payload,
            "digest_ok": None if revisit or named is None else named == own, "complete": len(raw) >= length}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        parsed = [{"path": r["path"], "at": r["at"], **parse(r["raw"], r["length"])} for r in rows]
        yield pa.RecordBatch.from_pylist(parsed, schema=_RECORDS)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the uncompressed archives in ``folder``: path, at
    (byte offset), record_id, record_type, url, refers_to, payload_digest,
    payload_bytes, payload (null for revisits), digest_ok and complete.

    For HTTP blocks the payload is what follows the HTTP header; a revisit's
    digest and size are those its header gives.  Files that do not begin with a
    record, and empty ones, have no rows.
    """
    files = spark.read.option("lineSep", _SEPARATOR).text(folder)
    source = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = checkpointed(source.mapInArrow(_pieces, "path string, block long, at long, size long, length long, raw binary"), "pieces")
    sums = pieces.groupBy("path", "block").agg(F.max(F.col("at") + F.col("size") + len(_SEPARATOR)).alias("total"))
    sums = checkpointed(sums.withColumn("before", F.sum("total").over(Window.partitionBy("path").orderBy("block")) - F.col("total")).select("path", "block", "before"), "sums")
    # a piece's offset is that of its "WARC/": 5 bytes before the piece, but for the file's first
    pieces = pieces.withColumnRenamed("at", "rel")
    placed = pieces.drop("raw").join(sums, ["path", "block"]).withColumn("at", F.col("before") + F.col("rel")).drop("before")
    first = F.col("at") == 0
    candidates = placed.where("length is not null").select("path", F.when(first, 0).otherwise(F.col("at") - 5).alias("at"),
                                                           (F.when(first, 5).otherwise(F.col("at")) + F.col("length") + 4).alias("next"))
    links = checkpointed(candidates, "candidates")
    kept = reachable(links).select("path", F.when(F.col("at") == 0, 0).otherwise(F.col("at") + 5).alias("at"), F.lit(True).alias("starts"))
    short = F.when(first, F.col("size") - 5).otherwise(F.col("size"))
    raw = F.when(first, F.expr("substring(raw, 6)")).otherwise(F.col("raw"))
    # most pieces are a whole record: only the others are looked up, so that payloads stay where they are
    marked = placed.join(kept.hint("merge"), ["path", "at"], "left")
    odd = checkpointed(marked.where(F.col("starts").isNull() | (short < F.col("length"))).select("path", "block", "rel", "at", "starts"), "odd")
    whole = pieces.join(odd.select("path", "block", "rel"), ["path", "block", "rel"], "left_anti").join(sums, ["path", "block"])
    whole = whole.withColumn("at", F.col("before") + F.col("rel")).select("path", "at", "length", raw.alias("raw"))
    marked = pieces.join(odd, ["path", "block", "rel"])
    return whole.unionByName(_glued(marked, short, raw)).mapInArrow(_records, "path string, at long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean, complete boolean")


#: Bytes of a file's stretch in which parts of a record are looked up.
_STRETCH = 1 << 20


def _glued(marked: DataFrame, short: Column, raw: Column) -> DataFrame:
    """Records whose payload holds the separator, put together from their pieces."""
    heads = marked.where(F.col("starts") & (short < F.col("length"))).select("path", F.col("at").alias("head"), "length", F.when(F.col("at") == 0, 5).otherwise(F.col("at")).alias("from"))
    near = heads.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("head") / _STRETCH), F.floor((F.col("from") + F.col("length")) / _STRETCH))))
    parts = marked.withColumn("stretch", F.floor(F.col("at") / _STRETCH)).where((F.col("starts") & (short < F.col("length"))) | F.col("starts").isNull())
    own = parts.select("path", "stretch", "at", raw.alias("raw")).join(near, ["path", "stretch"]).where("at >= head and at <= `from` + length")
    together = own.groupBy("path", "head", "length").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("parts"))  # a record's own bytes
    glue = F.expr("cast('" + _SEPARATOR.replace("\r", "\\r").replace("\n", "\\n") + "' as binary)")
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["raw"], lambda a, p: F.concat(a, glue, p["raw"]))
    return together.select("path", F.col("head").alias("at"), "length", joined.alias("raw"))


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the rows' records to ``folder`` and reads the archives back: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url and digest_ok.

    Empty tables give no rows; see ``write_warc`` for nulls, ties and repeats.
    """
    write_warc(pages, folder, id_col, url_col, payload_col, least)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:record:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return read_warc(pages.sparkSession, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url", "digest_ok")


#: What op2 returns, in DuckDB's SQL (table pages): base-32 digits are five bits each, four to five hex digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT, 1)), '') AS payload_digest FROM h),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""
