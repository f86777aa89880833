"""WARC archives: write pages as (segmented, chunk-framed) records, read them back, reassemble.

Writing: one record per page. Of pages with equal payloads the one with the largest id is a
``response``; the others are ``revisit`` records without payload. A response block is an HTTP
message with chunked transfer framing; blocks longer than ``segment_bytes`` go on in
``continuation`` records. Spark's text writer writes the files: the line separator is a record's
closing CRLF CRLF, so each file is a plain gzip'd WARC stream, and failed tasks leave nothing.

Reading: files are parsed by their records' Content-Length; segments are grouped by the origin
record's id, ordered by segment number, checked against gaps and the total length, joined, and
the chunked framing is decoded.

Defined results: null html is an empty payload; empty payloads are deduplicated like others; a
null page id sorts below every id and is written without the id header (a group of only null ids
is all responses); rows equal in id and payload are each a response if that id is the group's
largest; a null url has no target header; an empty table writes and reads no records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 5_000
CRLF = b"\r\n"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

RECORD_SCHEMA = ("record_id string, record_type string, page_id long, segment int, origin string, "
                 "total_length long, block binary, payload_digest string, payload_bytes long, refers_to long")


def base32(h: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: four groups of 40 bits, eight digits each."""
    digits = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), *_BASE32)


def with_roles(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to)``."""
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("sha1", F.sha1("payload"))
    first = base.groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    b, f = base.alias("b"), first.alias("f")
    rows = b.join(f, F.col("b.sha1") == F.col("f.sha1"))
    same = F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.select("page_id", "url", F.when(same, F.col("payload")).alias("payload"), base32(F.col("b.sha1")).alias("payload_digest"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.when(same, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
                       F.when(~same, F.col("response_id")).alias("refers_to"))


def _cut(data: bytes, at: int, size: int) -> int:
    """End of a piece of at most ``size`` bytes from ``at`` that splits no UTF-8 character."""
    end = min(at + size, len(data))
    cut = end
    while cut < len(data) and cut > at + 1 and data[cut] & 0xC0 == 0x80:
        cut -= 1
    return cut


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = _cut(data, at, size)
        yield data[at:end]
        at = end


def http_message(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for c in _pieces(payload, chunk_bytes):
        out += [b"%x\r\n" % len(c), c, CRLF]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(name: str, page_id, url, payload, digest, n_bytes, kind, refers_to,
                 segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of one page and its continuations, each without the closing CRLF CRLF."""
    rid = f"<urn:page:{'' if page_id is None else page_id}#{name}>"
    target = None if url is None else "".join(c if c not in "\r\n" else "%0A" for c in url)
    shared = [("Page-Id", page_id), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Payload-Length", n_bytes), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", f"<urn:page:{refers_to}>"), *shared], b"")
        return
    block = http_message(payload)
    parts = list(_pieces(block, segment_bytes))
    first = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *shared]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}.{i}>"), ("WARC-Segment-Origin-ID", rid),
                       ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages' records to the folder ``path`` (any file system that Spark writes)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    n += 1
                    out += page_records(f"{task}.{n}", r["page_id"], r["url"], r["payload"], r["payload_digest"],
                                        r["payload_bytes"], r["record_type"], r["refers_to"], segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = with_roles(pages).mapInArrow(records, "record binary")
    (rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
         .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a decompressed stream."""
    buf, at, ended = b"", 0, False

    def fill(need: int) -> bool:
        nonlocal buf, at, ended
        parts, have = [buf[at:]], len(buf) - at
        while have < need and not ended:
            x = next(data, None)
            if x is None:
                ended = True
            else:
                parts.append(x)
                have += len(x)
        buf, at = b"".join(parts), 0
        return have >= need

    while True:
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buf) - at + 1):
                if buf[at:].strip():
                    raise ValueError("the archive ends within a record's head")
                return
        head = buf[at:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        at, n = end + 4, int(fields["content-length"])
        if len(buf) - at < n + 4 and not fill(n + 4):
            raise ValueError("the archive ends within a record")
        block = buf[at:at + n]
        if buf[at + n:at + n + 4] != b"\r\n\r\n":
            raise ValueError("a record is not closed by two line ends")
        at += n + 4
        yield fields, block


def _inflate(content: memoryview, size: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed pieces of one or more gzip members (or the bytes as they are)."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[i:i + size]) for i in range(0, len(content), size))
        return
    z, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < len(content):
        chunk = rest or bytes(content[at:at + size])
        at += 0 if rest else len(chunk)
        piece, rest = z.decompress(chunk), b""
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)
        if piece:
            yield piece


def _page(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").removeprefix("urn:page:").partition("#")[0]
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """The records of the archives in ``path``, as stored (``RECORD_SCHEMA``): all of them, or only
    those that are (or are not) segments of a longer one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_records(_inflate(memoryview(content.as_buffer()))):
                    number = f.get("warc-segment-number")
                    if segmented is not None and segmented != bool(number or "warc-segment-origin-id" in f):
                        continue
                    total, n_bytes = f.get("warc-segment-total-length"), f.get("payload-length")
                    rows.append((f["warc-record-id"], f["warc-type"], _page(f["warc-record-id"]), int(number) if number else None,
                                 f.get("warc-segment-origin-id"), int(total) if total else None, block,
                                 f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 int(n_bytes) if n_bytes else None, _page(f.get("warc-refers-to"))))
                    size += len(block)
                    if len(rows) >= 1000 or size > 1 << 22:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2
        if body[at - 2:at] != CRLF:
            return None


def http_payload(message: bytes) -> bytes | None:
    head, sep, body = message.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:]))
    return dechunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _decode(records: DataFrame) -> DataFrame:
    """Decode ``(record_id, record_type, page_id, payload_digest, payload_bytes, refers_to, parts,
    whole)``, with ``parts`` the blocks in order, to the columns that ``reassemble`` returns."""

    @F.pandas_udf("binary")
    def payload(parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else http_payload(b"".join(p)) for p in parts], dtype=object)

    response = F.col("record_type") == "response"
    r = records.withColumn("payload", payload(F.when(response & F.col("whole"), F.col("parts"))))
    r = r.withColumn("found", F.when(response, base32(F.sha1("payload"))).otherwise(F.col("payload_digest")))
    status = (F.when(F.col("record_type").isNull(), "orphan").when(~F.col("whole"), "incomplete")
               .when(response & F.col("payload").isNull(), "bad framing")
               .when(response & (F.col("found") != F.col("payload_digest")), "bad digest").otherwise("ok"))
    n_bytes = F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return r.select("record_id", "record_type", "page_id", "payload", n_bytes.alias("payload_bytes"),
                    F.col("found").alias("payload_digest"), "refers_to", status.alias("status"))


_HEAD = ("record_type", "page_id", "payload_digest", "payload_bytes", "refers_to")


def join_segments(records: DataFrame) -> DataFrame:
    """One row per origin id: its blocks by segment number, and whether they are the whole record
    (numbers without gaps, lengths that add up to the total). Of segments with the same number
    one is taken. A group is one record's segments."""
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block")
    g = records.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.array_sort(F.collect_list(part)).alias("all_parts"), F.max("total_length").alias("total"), F.max("segment").alias("segments"),
        F.max(F.when(F.col("origin").isNull(), F.struct(*_HEAD))).alias("head"))
    g = g.withColumn("once", F.filter("all_parts", lambda x, i: (i == 0) | (x["segment"] != F.get(F.col("all_parts"), i - 1)["segment"])))
    length = F.aggregate("once", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    whole = (F.size("once") == F.coalesce("segments", F.lit(1))) & (F.coalesce("total", F.lit(-1).cast("long")) == length)
    return g.select("record_id", "head.*", F.transform("once", lambda x: x["block"]).alias("parts"), whole.alias("whole"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record of the archives: ``(record_id, record_type, page_id,
    payload, payload_bytes, payload_digest, refers_to, status)``.

    ``status`` is ``ok``, or ``incomplete`` (a segment is missing, or lengths do not add up),
    ``bad framing``, ``bad digest``, or ``orphan`` (continuations without an origin). The archives
    are read twice, so that only segments of longer records have to be moved.
    """
    single = read_records(spark, path, segmented=False)
    single = single.select("record_id", *_HEAD, F.array("block").alias("parts"), F.lit(True).alias("whole"))
    return _decode(single.unionByName(join_segments(read_records(spark, path, segmented=True))))
