"""WARC archives: a writer of gzip members with revisit records, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, new_path, small_enough
from loomspark.shipping import map_arrow

#: Bytes of a split; bytes read at once; compressed bytes looked at to tell whether a member starts here; compressed bytes decoded at once; gzip level.
SPLIT, CHUNK, PROBE, STEP, LEVEL = 8 << 20, 1 << 20, 1 << 12, 1 << 16, 2
#: Digests of several records that are broadcast at most.
BROADCAST = 1_000_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class _Store:
    """Files named by a uri, in a local folder or any file system that pyarrow knows."""

    def __init__(self, uri: str):
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            self._fs, self.path = None, parts.path
        else:
            from pyarrow import fs

            self._fs, self.path = fs.FileSystem.from_uri(uri)

    def open(self):
        return open(self.path, "rb") if self._fs is None else self._fs.open_input_file(self.path)

    def create(self):
        if self._fs is None:
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            return open(self.path, "wb")
        self._fs.create_dir(os.path.dirname(self.path), recursive=True)
        return self._fs.open_output_stream(self.path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without its payload, as one gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write each row as a WARC record and return the archives' (path, length).

    Of rows with equal payloads of at least so many bytes, those with the
    smallest id are responses and the others revisits of it; a payload of which
    all ids are null has responses only. Each task writes one file under a name
    of its own attempt, and only files in the returned table count, so failed
    and repeated attempts leave nothing that is read. Only digests that occur
    twice are joined with the rows, and payloads aren't shuffled unless more
    than BROADCAST digests do.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1")
    firsts = materialize(firsts.select(F.col("sha").alias("first_sha"), "first"), "digests")
    rows = rows.join(small_enough(firsts, BROADCAST), rows["sha"] == firsts["first_sha"], "left")
    rows = rows.select("id", "url", "payload", F.unhex("sha").alias("sha"), F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", None
        size = 0
        for batch in batches:
            out = out or _Store(path).create()
            for r in zip(*[batch.column(i) for i in range(5)]):
                page_id, url, payload, sha, refers = (x.as_py() for x in r)
                size += out.write(record(page_id, url, payload, base64.b32encode(sha).decode(), refers))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "length"])

    return materialize(map_arrow(rows, run, "path string, length long"), "archives")


def _head(data: bytes) -> bytes | None:
    """The first decoded bytes, if a member with a WARC header starts here."""
    if len(data) < 18 or data[3] & 0xE0:
        return None
    try:
        out = zlib.decompressobj(31).decompress(data, 256)
    except zlib.error:
        return None
    return out if out.startswith(b"WARC/1.") and b"\r\n" in out[:12] else None


def members(read, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC members that start in [start, end).

    read(offset, size) gives bytes of the file. The first member is found by
    its magic number and by decoding its header, so that bytes that look alike
    inside compressed data are passed over; after a member that ends well the
    next one is expected at once. Damaged members are passed over likewise.
    """
    at = start
    while at < end:
        window = read(at, min(CHUNK, end - at) + PROBE)
        found, i = None, -1
        while (i := window.find(MAGIC, i + 1)) >= 0 and at + i < end:
            if _head(window[i : i + PROBE]) is not None:
                found = at + i
                break
        if found is None:
            at += min(CHUNK, end - at)
            continue
        at = found
        while at < end:
            unpack, out, pos = zlib.decompressobj(31), [], at
            try:
                while not unpack.eof and pos < length:
                    data = read(pos, STEP)
                    out.append(unpack.decompress(data))
                    pos += len(data)
            except zlib.error:
                unpack = None
            body = b"".join(out)
            if unpack is None or not unpack.eof or not body.startswith(b"WARC/1."):
                at += 1
                break
            yield at, body
            at = pos - len(unpack.unused_data)
            nxt = read(at, PROBE) if at < end else b""
            if at < end and (not nxt.startswith(MAGIC) or _head(nxt) is None):
                break


def parse(body: bytes) -> dict:
    """A record's headers (names lower-cased), its HTTP headers under 'http', and its payload."""
    head, _, block = body.partition(b"\r\n\r\n")
    fields = dict(_field(x) for x in head.split(b"\r\n")[1:] if b":" in x)
    block = block[: int(fields.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": dict(_field(x) for x in http.split(b"\r\n")[1:] if b":" in x), "payload": payload}


def _field(line: bytes) -> tuple[str, str]:
    name, _, value = line.partition(b":")
    return name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()


def read_archives(spark: SparkSession, archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives (path, length): path, start, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, digest_ok, payload.

    Archives are cut into byte ranges, each read by a task of its own however
    large its file is; a record belongs to the range in which its member
    starts. A response's digest is computed from the payload read, and
    digest_ok tells whether the header agrees; a revisit's length and digest
    are those of the full payload, from its headers. Empty archives give no
    rows; payload is null for revisits, and for all if payloads is False.
    """
    ranges = archives.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    parts = max(1, ranges.count())
    ranges = ranges.repartition(min(parts, 100_000), "path", "start")
    schema = "path string, start long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def rows_of(path: str, start: int, end: int, length: int) -> Iterator[tuple]:
        with _Store(path).open() as f:

            def read(offset: int, size: int) -> bytes:
                f.seek(offset)
                return f.read(size)

            for at, body in members(_Buffered(read, length), start, end, length):
                r = parse(body)
                full = r["warc-type"] != "revisit"
                said = r.get("warc-payload-digest", "").removeprefix("sha1:")
                digest = digest_of(r["payload"]) if full else said
                n = len(r["payload"]) if full else int(r["http"].get("content-length", 0))
                yield path, at, r["warc-type"], r.get("warc-record-id", ""), r.get("warc-target-uri", ""), r.get("warc-refers-to"), n, digest, digest == said, r["payload"] if full and payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                held, size = [], 0
                for row in rows_of(path, start, min(start + split, length), length):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return map_arrow(ranges, run, schema)


class _Buffered:
    """Reads at an offset from one buffer of a few CHUNKs that moves along the file."""

    def __init__(self, read, length: int):
        self._read, self._length, self._at, self._data = read, length, 0, b""

    def __call__(self, offset: int, size: int) -> bytes:
        size = max(0, min(size, self._length - offset))
        if not (self._at <= offset and offset + size <= self._at + len(self._data)):
            self._at, self._data = offset, self._read(offset, max(size, 2 * CHUNK))
        return self._data[offset - self._at : offset - self._at + size]


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and return (id_col, payload_bytes, payload_digest, record_type, refers_to, digest_ok).

    Null html is an empty payload; equal payloads, even empty ones, are one
    response and revisits of it. Null urls are written empty. Rows that repeat
    the smallest id of a payload are responses each. A row with a null id has a
    null id in the result and revisits the payload's smallest id, if any. No
    rows give no archives and no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), id_col, url_col, html_col, least)
    found = read_archives(spark, archives, payloads=False)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")
    return found.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "digest_ok")
