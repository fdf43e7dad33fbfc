"""ARC archives and their conversion to WARC.

An ARC file is a version block (filedesc://), then records: one header line whose fields depend on the version, the
declared number of bytes, and a line feed. Version 1 lines have five fields, version 2 lines ten. The converter walks the
file by declared lengths and synthesises what WARC asks for: record ids from the archive's name and the record's offset, ISO
times from 14-digit dates, types from the content, SHA-1 digests of payload and block. A payload that occurs again becomes a
revisit record, which keeps the HTTP header but not the payload.

Files are written by Spark's text writer (a record per row; the record end is the line separator) with gzip, so any
store that Spark reaches will do and a lost task is written anew. They are read as whole binary rows, one archive per row, and parsed as a
stream, so memory is bounded by an archive's compressed size and its longest record; an archive holds what one input
split holds. Payloads are never shuffled: which records repeat is decided on digests, and only the list of an archive's revisits is
joined to the archive. Equal payloads are pre-aggregated, and hot ones joined by `join_hot`.

Defined cases: null html is an empty payload, a null url is `urn:none`; white space and control characters of a url are percent-encoded.
The response is the record with the least page_id (null last, then archive and offset), so of repeated rows one is the response and the
others revisit it. Extra columns are ignored. An empty table gives archives without records. A header line that can't be
parsed, or a wrong digest on reading, is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import join_hot, store
from quillgraph.session import scratch_path

ADDRESS = "0.0.0.0"
CAPTURED = "20080101000000"
WARC_END = "\r\n\r\n"
# Header fields of the two ARC versions, and WARC names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def _strings(rows: list[bytes]) -> pa.Array:
    """UTF-8 text column from bytes, without decoding them."""
    return pa.array(rows, pa.binary()).view(pa.string())


# --- ARC ---------------------------------------------------------------------------------------------------------

def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} {ADDRESS} {date} text/plain{middle} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, date: str = CAPTURED) -> None:
    """One gzip ARC file per partition of `pages` (page_id, url, html), of version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, offset = part % 2 + 1, f"pages-{part:06d}.arc", 0
        first = True
        for batch in batches:
            rows = [arc_version_block(name, version, date)] if first else []
            offset += sum(len(r) + 1 for r in rows)
            first = False
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8") if html else b""
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                doc = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                middle = "" if version == 1 else f" 200 - - {offset} {name}"
                rows.append(f"{clean_url(url)} {ADDRESS} {date} text/html{middle} {len(doc)}\n".encode() + doc)
                offset += len(rows[-1]) + 1
            yield pa.record_batch([_strings(rows)], names=["value"])

    pages.select("page_id", "url", "html").mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


@dataclass
class ArcRecord:
    archive: str
    offset: int
    url: str
    address: str
    date: str
    mime: str
    block: bytes


def open_archive(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file (plain or gzip). A later version block changes the fields that follow."""
    stream, offset, fields, name = open_archive(content), 0, ARC_FIELDS[1].split(), ""
    while line := stream.readline():
        begin = offset
        offset += len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text.startswith("filedesc://"):
            size = int(text.rsplit(" ", 1)[1])
            block = stream.read(size)
            offset += size
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            fields = (lines[1] if len(lines) > 1 else ARC_FIELDS[version]).split()
            name = text.split(" ", 1)[0]
            continue
        values = text.rsplit(" ", len(fields) - 1)  # old urls may hold blanks
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {begin} of {name}: {text[:200]}")
        got = dict(zip(fields, values))
        size = int(got["Archive-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{name}: record at byte {begin} ends early")
        offset += size
        yield ArcRecord(name, begin, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], block)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its end, and payload; a block without HTTP header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[:at + 4], block[at + 4:])


def http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


# --- conversion --------------------------------------------------------------------------------------------------

def record_id(r: ArcRecord) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{r.archive}|{r.offset}'.encode()).digest()[:16], version=5)}>"


def iso_date(date: str) -> str:
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(r: ArcRecord, refers: dict | None) -> bytes:
    """WARC record without its end. refers: record_id, url, date, page_id of the response if this is a revisit."""
    header, payload = http_parts(r.block)
    block = header if refers else r.block
    kind = "revisit" if refers else "response" if header or r.url.startswith("dns:") else "resource"
    mime = "application/http;msgtype=response" if header else r.mime
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(r)), ("WARC-Date", iso_date(r.date)), ("WARC-Target-URI", r.url),
              ("WARC-IP-Address", r.address), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if refers:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers["record_id"]), ("WARC-Refers-To-Target-URI", refers["url"]),
                   ("WARC-Refers-To-Date", iso_date(refers["date"]))]
        if refers["page_id"] is not None:
            fields.append(("X-Refers-To-Page-Id", refers["page_id"]))
    fields += [("Content-Type", mime), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content: one row per archive file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, record_id, url, date, page_id, digest, payload_bytes of every ARC record; no payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in read_arc(content.as_buffer()):
                    header, payload = http_parts(r.block)
                    page = http_field(header, "X-Page-Id")
                    rows.append((where.as_py(), r.offset, record_id(r), r.url, r.date, None if page is None else int(page), sha1_base32(payload), len(payload)))
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          names=["path", "offset", "record_id", "url", "date", "page_id", "digest", "payload_bytes"])

    return archives(spark, path).mapInArrow(run, "path string, offset bigint, record_id string, url string, date string, page_id bigint, digest string, payload_bytes bigint")


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """path, refers: per archive the offsets of its revisits, each with the response it refers to."""
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("page_id"), F.col("path").alias("first_path"),
                     F.col("offset").alias("first_offset"), F.col("record_id").alias("first_id"), F.col("url").alias("first_url"), F.col("date").alias("first_date"))
    large = index.filter(F.col("payload_bytes") >= min_bytes)
    groups = store(large.groupBy("digest", "payload_bytes").agg(F.min(order).alias("o"), F.count("*").alias("n")).filter("n > 1")
                   .select("digest", "n", F.struct("o.page_id", "o.first_path", "o.first_offset", "o.first_id", "o.first_url", "o.first_date").alias("first")), "payloads")
    again = join_hot(large.select("digest", "path", "offset"), groups, "digest", "n").filter(
        "path <> first.first_path OR offset <> first.first_offset")
    return again.groupBy("path").agg(F.collect_list(F.struct(
        "offset", F.col("first.first_id").alias("record_id"), F.col("first.first_url").alias("url"), F.col("first.first_date").alias("date"),
        F.col("first.page_id").alias("page_id"))).alias("refers"))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Convert every ARC file under `arc_path` to a gzip WARC file under `warc_path`."""
    index = store(arc_index(spark, arc_path), "arc_index")
    again = store(revisits(index, min_bytes), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, refers in zip(batch.column("content"), batch.column("refers")):
                known = {x["offset"]: x for x in refers.as_py() or ()}
                rows, size = [], 0
                info = b"software: quillgraph\r\nformat: WARC File Format 1.1\r\n"
                for r in read_arc(content.as_buffer()):
                    if not rows and not size:
                        own = hashlib.sha1(r.archive.encode()).digest()[:16]
                        rows.append((f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=own, version=5)}>\r\nWARC-Date: {iso_date(r.date)}\r\n"
                                     f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n").encode() + info)
                    rows.append(warc_record(r, known.get(r.offset)))
                    size += len(rows[-1])
                    if len(rows) >= 1000 or size > 1 << 23:
                        yield pa.record_batch([_strings(rows)], names=["value"])
                        rows, size = [], 1
                if rows:
                    yield pa.record_batch([_strings(rows)], names=["value"])

    files = archives(spark, arc_path).join(again, "path", "left").select("content", "refers")
    files.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", WARC_END).text(warc_path)


# --- WARC --------------------------------------------------------------------------------------------------------

def read_warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    stream = open_archive(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("WARC record ends early")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, page_id, record_type, payload_bytes, payload_digest, refers_to of every response and revisit; digests are verified."""
    names = ("record_id", "url", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in read_warc_records(content.as_buffer()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    header, payload = http_parts(block)
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    again = f["warc-type"] == "revisit"
                    if sha1_base32(block) != f["warc-block-digest"].removeprefix("sha1:") or not again and sha1_base32(payload) != digest:
                        raise ValueError(f"wrong digest in {f['warc-record-id']}")
                    page, first = http_field(header, "X-Page-Id"), f.get("x-refers-to-page-id")
                    size = int(http_field(header, "Content-Length") or 0) if again else len(payload)
                    rows.append((f["warc-record-id"], f["warc-target-uri"], None if page is None else int(page), f["warc-type"], size, digest,
                                 None if first is None else int(first)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return archives(spark, path).select("content").mapInArrow(
        run, "record_id string, url string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint")


def through_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write `pages` as ARC, convert to WARC, and read the WARC files back."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
