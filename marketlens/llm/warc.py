"""Operator 10: WARC archives, written with revisit records and read by byte ranges.

Each page is a record in a gzip member of its own. Of records with equal payloads of REVISIT_BYTES or more, that with
the largest page_id is the response and the others are revisits that refer to it. A reading task scans a byte range
for gzip magic, takes an offset for a record's start only where a WARC header can be decoded there, and owns the
records that start inside its range; from a record it goes on at the end of its member.

Files are written under a name of their own and then moved, so a task that runs again replaces its file by the same one.

Defined cases: null html is an empty payload; null page_id is kept (as `none` in the archive); of rows with equal
page_id and payload all are responses if that page_id is the largest; pages without url have none in the archive;
further columns are ignored; an empty table gives archives without records. A header may be of any length; a record
that an archive's end cuts off, or whose header never ends, raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pa_schema, salted, scratch

REVISIT_BYTES = 1000
RANGE_BYTES, MOST_TASKS = 8 << 20, 20_000
CHUNK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str):
    """The file system of a path, by any scheme that Arrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: one row for each page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    known = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = salted(rows, known.select("payload_digest", "first"), "payload_digest", F.xxhash64("page_id"))  # a common payload's rows go to several tasks
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"), refers.alias("refers_to"))


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = [("WARC-Target-URI", re.sub(r"[\r\n]", "", url))] if url is not None else []
    fields = [("WARC-Record-ID", _uri(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), *target, ("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", [*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))], http)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each task and returns a table (path, bytes) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        files.create_dir(root, recursive=True)
        part, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0
        with files.open_output_stream(part, compression=None) as out:
            for data in (_record("warcinfo", [("WARC-Record-ID", "<urn:archive>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"),):
                size += out.write(data) or len(data)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    data = b"".join(page_record(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True))
                    out.write(data)
                    size += len(data)
        files.move(part, f"{root}/{name}")
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return cut(planned(pages).select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long"), "archives")


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record whose member starts in [start, end). source: a seekable file."""
    at = start
    while at < end:
        source.seek(at)
        window = source.read(min(CHUNK, size - at))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        record, after = member_at(source, size, at)
        if record is None:
            at += 1
        else:
            yield record
            at = after


def member_at(source, size: int, at: int) -> tuple[tuple[dict[str, str], bytes] | None, int]:
    """The record whose gzip member starts at an offset and where the member ends; None where no WARC record does."""
    source.seek(at)
    unpack, data, known, seen = zlib.decompressobj(31), bytearray(), False, 0
    while not unpack.eof:
        piece = source.read(CHUNK)
        if not piece:
            if data.startswith(b"WARC/1."):
                raise ValueError(f"the archive ends within the record at {at}")
            return None, at
        try:
            data += unpack.decompress(piece)
        except zlib.error:
            return None, at
        if not known:
            if len(data) >= 7 and not data.startswith(b"WARC/1."):
                return None, at
            known, seen = data.find(b"\r\n\r\n", max(0, seen - 3)) >= 0, len(data)
    if not known:
        if data.startswith(b"WARC/1."):
            raise ValueError(f"the record at {at} has no end of its header")
        return None, at
    after = source.tell() - len(unpack.unused_data)
    head, _, rest = bytes(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not fields.get("Content-Length", "").isdigit() or "WARC-Type" not in fields:
        return None, at
    return (fields, rest[: int(fields["Content-Length"])]), after


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each response and revisit record. archives: path, bytes. There are as many tasks as ranges of RANGE_BYTES, up to MOST_TASKS."""
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / RANGE_BYTES))).head()[0] or 1
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa_schema(RECORDS)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                files, place = _open(path)
                rows, held = [], 0
                with files.open_input_file(place) as source:
                    for fields, block in records_in(source, size, start, min(size, start + RANGE_BYTES)):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if kind == "response":
                            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            length, digest = int(fields["WARC-Payload-Length"]), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), length, digest, kind, _page(fields.get("WARC-Refers-To")), payload if payloads else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return ranges.repartitionByRange(max(1, min(tasks, MOST_TASKS)), "path", "start").mapInArrow(run, RECORDS)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives in the shared folder."""
    archives = write(pages, scratch(pages.sparkSession, "warc"))
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
