"""WARC archives (operator 13): a writer of one gzip member a record, and a reader that salvages what is left of damaged ones.

The writer makes a response record for the first page (smallest page_id) of each payload, and for others of the same payload,
if it has 100 bytes or more, a revisit record that refers to it and has no payload. Spark's text writer puts the members
into files; between them it puts an empty gzip member, which is what a line separator is here.

The reader takes one archive at a time, compressed by member or plain. A member must decompress with the right checksum, a
record must have a version line, header fields, a length within the archive, its closing lines and the digest that it names.
Where a check fails, the next place that looks like a member or a version line is tried, and so on; what lies between is
logged as a gap with its place and the reason. Records after a gap are read as before it.

Null html or url: empty payload, no target. A null page_id is larger than all others, and is not named by its record. Rows that
repeat a page_id and its payload are the same capture: they have the same type. Other columns aren't read. An empty table
has no archives. Archives hold at most ``records`` records, which bounds the memory of a task that reads one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import Tables

#: Payloads of fewer bytes are always written.
LEAST = 100
RECORDS = 2048
#: So many distinct payloads with copies are broadcast; more are met by a shuffle.
SMALL = 200_000
VERSION, MAGIC, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
EMPTY = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, without the two lines that close it."""
    urn = lambda p: f"<urn:page:{'' if p is None else p}:{digest}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url:  # control characters, blanks too, can't stand in a header
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def planned(pages: DataFrame, tables: Tables) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to of each page. Only payloads that have copies are met again."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    long_ = pages.where(F.octet_length(body) >= LEAST).select(F.sha2(body, 256).alias("digest"), F.col("page_id").cast("long").alias("page_id"))
    first = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    first = tables.write(first.where("first < last OR (first IS NOT NULL AND nameless > 0)").select("digest", "first"))
    few = first.limit(SMALL + 1).count() <= SMALL
    out = rows.join(F.broadcast(first) if few else first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return out.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, tables: Tables, compress: bool = True, records: int = RECORDS, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record of each of ``pages`` (page_id, url, html) to archives under ``path``, in whatever store Spark writes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out = []
                for page, url, html, digest, revisit, refers in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    r = record(page, url, html.encode(), digest, refers, revisit, date)
                    out.append(member(r + END) if compress else r)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = planned(pages, tables).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    between = EMPTY if compress else END
    made.write.option("encoding", "ISO-8859-1").option("lineSep", between.decode("latin-1")).option("maxRecordsPerFile", records).option("compression", "none").text(path)


@dataclass
class Found:
    """A record (with its fields and block) or, if ``reason`` is set, a gap."""

    offset: int
    length: int
    fields: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None


def plain_record(data: bytes, at: int) -> tuple[Found | None, int, str]:
    """(record, its end, ''), or (None, at, what is wrong), of the uncompressed record at a place."""
    stop = data.find(END, at)
    if stop < 0:
        return None, at, "header without end"
    lines = data[at:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        return None, at, "no version line"
    fields: dict[str, str] = {}
    for line in lines[1:]:
        m = _FIELD.fullmatch(line)
        name = m[1].decode().lower() if m else ""
        if not m or (name in fields and name != "warc-concurrent-to"):  # a cut header runs on into the next record's
            return None, at, "header field"
        fields[name] = m[2].decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return None, at, "no length"
    begin, end = stop + len(END), stop + len(END) + int(size)
    if data[end : end + len(END)] != END:
        return None, at, "length" if end + len(END) <= len(data) else "truncated"
    block = data[begin:end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and digest.lower() != hashlib.sha256(block).hexdigest():
        return None, at, "block digest"
    return Found(at, end + len(END) - at, fields, block), end + len(END), ""


def gzip_member(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:])
    except zlib.error:
        return None, at, "member"
    if not d.eof:
        return None, at, "truncated member"
    return out, len(data) - len(d.unused_data), ""


def salvage(data: bytes, nested: bool = True) -> Iterator[Found]:
    """The records of one archive in order, and the gaps between them that nothing could be read from."""
    at, gap, why = 0, None, ""
    size = len(data)
    while at < size:
        found: list[Found] = []
        if nested and data.startswith(MAGIC, at):
            inner, end, bad = gzip_member(data, at)
            if inner is not None:
                for f in salvage(inner, False):  # places are those of the member
                    found.append(Found(at, end - at, f.fields, f.block, f.reason))
        elif data.startswith(VERSION, at):
            one, end, bad = plain_record(data, at)
            if one is not None:
                found = [one]
        else:
            end, bad = at, "no record"
        if end > at:
            if gap is not None:
                yield Found(gap, at - gap, reason=why)
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, why = at, bad
        near = [k for k in (data.find(VERSION, at + 1), data.find(MAGIC, at + 1) if nested else -1) if k >= 0]
        at = min(near, default=size)
    if gap is not None:
        yield Found(gap, size - gap, reason=why)


def _page(urn: str) -> int | None:
    m = re.match(r"<urn:page:(-?\d+):", urn)
    return int(m[1]) if m else None


READ = "file string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload_ok boolean, payload binary"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records and gaps (reason is set) of the archives under ``path``.

    The payload of a response is what follows the header of its HTTP message; ``payload_ok`` tells whether it has the digest that
    the record names. A revisit has the digest and length that it names, and no payload. Without ``payload`` that column is null.
    """

    def one(file: str, f: Found) -> tuple:
        if f.reason is not None:
            return (file, f.offset, f.length, f.reason, *[None] * 8)
        kind, h = f.fields.get("warc-type"), f.fields
        head, _, body = f.block.partition(END) if h.get("content-type", "").startswith("application/http") else (b"", b"", f.block)
        named = h.get("warc-payload-digest", "").partition(":")[2].lower() or None
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
        if kind == "revisit":
            n, digest, ok, body = int(size[1]) if size else None, named, None, None
        else:
            n, digest = len(body), hashlib.sha256(body).hexdigest()
            ok = None if named is None else named == digest
        return file, f.offset, f.length, None, _page(h.get("warc-record-id", "")), h.get("warc-target-uri"), kind, _page(h.get("warc-refers-to", "")), n, digest, ok, body if payload else None

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = [x.split()[0] for x in READ.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                file, rows = b.column(0)[k].as_py(), []
                for f in salvage(b.column(1)[k].as_py()):
                    rows.append(one(file, f))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "warc")
    at = f"{tables.at}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), at, tables)
    return read_archives(spark, at, payload=False).where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first OR page_id IS NULL THEN first END AS refers_to FROM p LEFT JOIN f ON f.h = p.h"""
