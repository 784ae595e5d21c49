"""WARC archives with an index: write once, then read chosen records by byte range.

Writing: pages are joined with the first page of their payload's digest, every
task writes archives of gzip members, one per record, into the shared folder,
and returns one index row per record: file, offset, length, url, digest.  A
payload that an earlier page has is written as a revisit record without it.
The index is a table; files of failed attempts are in no index row and so are
never read.

Reading: the index rows wanted are sorted by file and offset; neighbouring
ranges are read in one request, up to a bound, and each record is parsed,
unpacked and checked against its digest.

Edge cases: a null html is an empty payload; a null url is left out of the
record; pages that tie for the smallest id are all responses; with no id at all
in a group of equal payloads all are responses; an empty table gives an empty
index.  Payloads are text, so any storage that pyarrow can open will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.llm.common import stored
from textpair.session import shared_dir, ship_package

LEAST_BYTES = 0
FILE_BYTES = 1 << 30
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the response's header, which tells the payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def header_fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parsed(member: bytes) -> dict:
    """The record in a gzip member; raises where payload and digest differ."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(header_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not have the payload of its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix(f"<{RECORD_ID}").removesuffix(">")
        return int(number) if number else None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"),
        "payload": None if revisit else payload,
    }


def write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = {c: [] for c in ("file", "offset", "length", "digest", "record_type")}
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode()
                    digest = payload_digest(payload)
                    member = packed(record(page_id, url, payload, digest, refers_to))
                    out.write(member)
                    for column, value in zip(rows, (
                        name, at, len(member), digest, "response" if refers_to is None else "revisit",
                    ), strict=True):
                        rows[column].append(value)
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()),
                        pa.array(rows["length"], pa.int64()), batch.column("url"), pa.array(rows["digest"], pa.string()),
                        batch.column("page_id"), pa.array(rows["record_type"], pa.string()), batch.column("refers_to"),
                    ],
                    names=["file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def read_batches(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, ranges in coalesced(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                with store.open_input_file(f"{base}/{name}") as source:
                    source.seek(start)
                    data = source.read(ranges[-1][0] + ranges[-1][1] - start)
                records = [parsed(data[offset - start : offset - start + length]) for offset, length in ranges]
                if not with_payload:
                    for r in records:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(records, pa.schema([
                    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
                ]))

    return run


def coalesced(files: list[str], offsets: list[int], lengths: list[int]):
    """Sorted byte ranges joined to requests: ``(file, start, ranges)``."""
    name, start, ranges = None, 0, []
    for file, offset, length in zip(files, offsets, lengths, strict=True):
        near = name == file and offset - (ranges[-1][0] + ranges[-1][1]) <= GAP_BYTES
        if ranges and not (near and offset + length - start <= READ_BYTES):
            yield name, start, ranges
            ranges = []
        if not ranges:
            name, start = file, offset
        ranges.append((offset, length))
    if ranges:
        yield name, start, ranges


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one record per page below ``folder``; the index as a table in the shared folder."""
    ship_package(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("_digest", F.sha1(F.encode("html", "utf-8")))
    repeated = (
        rows.where(F.octet_length("html") >= least_bytes).groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
        .select("_digest", "_first")
    )
    linked = rows.join(repeated, "_digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to")
    )
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return stored(linked.mapInArrow(write_batches(folder), INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the index rows, read from the archives."""
    spark = index.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(read_batches(folder, with_payload), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read every record back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, with_payload=False)
