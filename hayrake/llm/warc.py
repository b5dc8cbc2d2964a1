"""WARC archives: a writer with revisit records and a splittable reader.

An archive is a row of gzip members, one for each record. The reader deals
byte ranges of the files to tasks: each looks for the gzip magic in its
range, accepts a candidate if it decodes to a WARC header whose record has
the stated length, and owns the records that start inside the range (the last
may end beyond it). After what is no valid record, such as a damaged or cut
member or other bytes, the search goes on at the next magic; how many bytes
were passed over is counted.

A payload may hold members itself (an archive that was archived). So a first
pass finds how far the records of each range reach, and a range is read from
where those of earlier ranges end. Only inside a damaged record, whose extent
nobody knows, members of its payload are records of their own.

Files are reached by `pyarrow.fs`, so the folder may be on any store that it
knows. Defined results: a null payload is empty; null addresses are left out
of the headers; repeated rows are written once for each row (rows with the
smallest page_id of their payload are all responses); an empty table writes
no archive and reads as no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hayrake.session import materialise, prepare

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive for one reading task, and of an archive before the next one begins.
RANGE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
#: Dates of records are fixed so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"
#: Broadcast at most so many payload digests that occur repeatedly.
BROADCAST_ROWS = 500_000

RECORD = "path string, offset bigint, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, headers map<string,string>, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with headers only."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{_clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def first_of_payload(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with first_id: the smallest page_id of those with an equal payload."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_key", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    again = pages.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    again = materialise(again, "payloads")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return pages.join(again, "_key", "left").drop("_key")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page below folder; returns the manifest: path, bytes, records.

    A task writes files of its own under fresh names; only those that the
    manifest names, which successful tasks return, are part of the archive.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        out, path, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

        for batch in batches:
            ids, urls, texts, firsts = (batch.column(c) for c in range(4))
            for k in range(len(batch)):
                page, first = ids[k].as_py(), firsts[k].as_py()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                to = f"urn:page:{first}" if first is not None and first != page else None
                raw = record(f"urn:page:{'' if page is None else page}", urls[k].as_py(), (texts[k].as_py() or "").encode(), to)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    marked = first_of_payload(pages, least_bytes).select("page_id", "url", "html", "first_id")
    return materialise(marked.mapInArrow(run, "path string, bytes bigint, records bigint"), "manifest")


class Ranged:
    """Bytes of a file from a place on, fetched as they are needed."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not self.at <= start or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, 1 << 20))
        return self.held[start - self.at : start - self.at + n]


def member(source: Ranged, at: int, keep: bool = True) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block (on request) and end of the gzip member at a place, if it holds one record of the length that it states."""
    if source.get(at, 3) != MAGIC:
        return None
    unpack, pos, raw, size, tail, headers, want = zlib.decompressobj(31), at, bytearray(), 0, b"", None, 0
    try:
        while not unpack.eof:
            chunk = source.get(pos, 1 << 16)
            if not chunk:
                return None
            pos += len(chunk)
            part = unpack.decompress(chunk)
            size += len(part)
            tail = (tail + part)[-4:]
            if keep or headers is None:
                raw += part
            if headers is None:
                if not b"WARC/1.".startswith(bytes(raw[:7])):
                    return None
                cut = raw.find(b"\r\n\r\n")
                if cut >= 0:
                    headers = parse(bytes(raw[:cut]))
                    if headers is None:
                        return None
                    want = cut + 8 + int(headers["content-length"])
                    del raw[: cut + 4]
            if headers is not None and size > want:
                return None
    except zlib.error:
        return None
    if headers is None or size != want or tail != b"\r\n\r\n":
        return None
    return headers, bytes(raw[:-4]) if keep else b"", pos - len(unpack.unused_data)


def parse(head: bytes) -> dict[str, str] | None:
    """The headers of a record, if they name its type and length."""
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    return headers if size.isascii() and size.isdigit() and len(size) < 19 and "warc-type" in headers else None


def records_of_range(source: Ranged, start: int, end: int, keep: bool = True) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Start, end, headers and block of the valid records that begin in a range."""
    at = start
    while at < end:
        window = source.get(at, min(1 << 20, end - at + len(MAGIC) - 1))
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        got = member(source, at, keep)
        if got is None:
            at += 1
        else:
            yield at, got[2], got[0], got[1]
            at = got[2]


def ranges_of(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, bytes, start and end of each range, and begin: where the records of earlier ranges have ended."""
    starts = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                reach, end = 0, min(row["bytes"], row["start"] + range_bytes)
                with store.open_input_file(path) as file:
                    for _, reach, _, _ in records_of_range(Ranged(file, row["bytes"]), row["start"], end, keep=False):
                        pass
                yield pa.RecordBatch.from_pylist([row | {"end": end, "reach": reach}], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("bytes", "start", "end", "reach"))]))

    found = _dealt(starts).mapInArrow(run, "path string, bytes bigint, start bigint, end bigint, reach bigint")
    before = F.max("reach").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return materialise(found.withColumn("begin", F.greatest("start", F.coalesce(before, F.lit(0)))).drop("reach"), "ranges")


def _dealt(ranges: DataFrame) -> DataFrame:
    return ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4, "path", "start")


def passed_over(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, records and skipped (bytes that belong to no valid record) of each range."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                n, used = 0, 0
                with store.open_input_file(path) as file:
                    for a, z, _, _ in records_of_range(Ranged(file, row["bytes"]), row["begin"], row["end"], keep=False):
                        n, used = n + 1, used + min(z, row["end"]) - a
                skipped = max(0, row["end"] - row["begin"] - used)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "start": row["start"], "records": n, "skipped": skipped}], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "records", "skipped"))]))

    return _dealt(ranges_of(spark, manifest, range_bytes)).mapInArrow(run, "path string, start bigint, records bigint, skipped bigint")


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All valid records of the archives of a manifest (path, bytes): a row for each, with headers and payload.

    `passed_over` says how many bytes belong to none.
    """
    prepare(spark)
    ranges = _dealt(ranges_of(spark, manifest, range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _file_system(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, _, headers, block in records_of_range(Ranged(file, row["bytes"]), row["begin"], row["end"]):
                        revisit = headers["warc-type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        rows.append({
                            "path": row["path"], "offset": at, "record_id": headers.get("warc-record-id", "")[1:-1], "record_type": headers["warc-type"], "target_uri": headers.get("warc-target-uri"),
                            "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload), "payload_bytes": int(headers.get("x-payload-length", 0)) if revisit else len(payload),
                            "refers_to": headers.get("warc-refers-to", "<>")[1:-1] or None, "headers": list(headers.items()), "payload": payload,
                        })
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return ranges.mapInArrow(run, RECORD)


ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
