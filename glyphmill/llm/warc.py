"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``, each compressed on
its own.  A bundle is a run of frames closed by a seek table in a skippable
frame (the public seekable format), so any frame is found from the last bytes
of the file.  The index maps every record to its bundle, frame, and offset
inside the decompressed frame.

Bundles are written by the tasks into a folder all executors share (any URI
that pyarrow's file systems open).  A file's name carries its task attempt, and
only the index rows of finished tasks name files, so a repeated task leaves at
most an unused file.

* A null html is an empty payload; a null url leaves out the target line.
* Of equal payloads of at least ``min_revisit_bytes`` bytes the one with the
  largest ``page_id`` is the response, all others revisit it.  Rows with a null
  id revisit a named one, and are responses where there is none.
* Repeated rows are repeated records; those of the response stay responses.
* An empty table writes no bundle and reads back no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import body, modest_batches
from glyphmill.session import work_path, written

# Fixed values of the public seekable Zstandard and WARC formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
FOOTER = "<IBI"
ENTRY = "<II"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, bundle string, frame int, frame_offset bigint, length bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


@dataclass(frozen=True)
class Params:
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 64 << 20
    level: int = 3
    min_revisit_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"


def with_originals(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """``page_id, url, payload, digest`` (hex SHA-1) and ``refers_to`` (null for a response).

    Only digests are grouped (map-side first) and only those of repeated
    payloads come back, so a payload that a third of all pages share is one
    row of the joined side.
    """
    modest_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.encode(body("html"), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    originals = (
        rows.filter(F.octet_length("payload") >= params.min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .drop("n")
    )
    joined = rows.join(written(originals, "originals"), "digest", "left")
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("original"))).drop("original")


def _name(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)
        lines.insert(3, f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """One seekable bundle: add records, close, read ``index`` rows."""

    def __init__(self, files: fs.FileSystem, path: str, uri: str, params: Params):
        self.out, self.uri, self.params = files.open_output_stream(path, compression=None), uri, params
        self.zstd = zstandard.ZstdCompressor(level=params.level, write_checksum=True)
        self.pending: list[bytes] = []
        self.filled = self.size = 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple] = []

    def add(self, page_id, record: bytes) -> None:
        self.index.append((page_id, self.uri, len(self.frames), self.filled, len(record)))
        self.pending.append(record)
        self.filled += len(record)
        if self.filled >= self.params.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            frame = self.zstd.compress(b"".join(self.pending))
            self.out.write(frame)
            self.frames.append((len(frame), self.filled))
            self.size += len(frame)
            self.pending, self.filled = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack(ENTRY, *f) for f in self.frames) + struct.pack(FOOTER, len(self.frames), 0, SEEK_TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, located through its seek table."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size, tail = self.file.size(), struct.calcsize(FOOTER)
        count, _, magic = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(count * 8, size - tail - count * 8)
        self.places, at = [], 0
        for packed, full in struct.iter_unpack(ENTRY, table):
            self.places.append((at, packed, full))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, full = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=full)

    def close(self) -> None:
        self.file.close()


def write_bundles(records: DataFrame, folder: str, params: Params = Params()) -> DataFrame:
    """Write the records of ``with_originals`` below ``folder``; the index of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task, bundle, n = TaskContext.get().taskAttemptId(), None, 0

        def finished(b: BundleWriter) -> pa.RecordBatch:
            b.close()
            names = ["page_id", "bundle", "frame", "frame_offset", "length"]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*b.index), types)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                if bundle is None:
                    name = f"bundle-{task:08d}-{n:05d}.warc.zst"
                    bundle, n = BundleWriter(files, f"{base}/{name}", f"{folder}/{name}", params), n + 1
                code = base64.b32encode(bytes.fromhex(digest)).decode()
                bundle.add(page_id, record_bytes(page_id, url, payload, code, refers_to, params.date))
                if bundle.size >= params.bundle_bytes:
                    yield finished(bundle)
                    bundle = None
        if bundle is not None:
            yield finished(bundle)

    wanted = records.select("page_id", "url", "payload", "digest", "refers_to")
    return written(wanted.mapInArrow(write, INDEX), "warc-index")


def parse_record(data: bytes, at: int) -> tuple[tuple, int]:
    """The record at ``at`` as a row of ``RECORD``, and where the next one begins."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(head["Content-Length"])
    body_start = data.index(b"\r\n\r\n", start) + 4
    http = dict(line.split(": ", 1) for line in data[start : body_start - 4].decode().split("\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(data[body_start:end]).digest()).decode()
        if found != digest or end - body_start != int(http["Content-Length"]):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        tail = name.removeprefix("<urn:page:").removesuffix(">")
        return None if tail == "none" else int(tail)

    refers = page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    row = (page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, head["WARC-Type"], refers)
    return row, end + 4


def _rows(found: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of every bundle that the index names, frame by frame."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                bundle = BundleReader(uri)
                for number in range(len(bundle.places)):
                    data, at, found = bundle.frame(number), 0, []
                    while at < len(data):
                        row, at = parse_record(data, at)
                        found.append(row)
                    yield _rows(found)
                bundle.close()

    return index.select("bundle").distinct().mapInArrow(read, RECORD)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given ``page_id``s, decompressing only the frames that hold them."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi")

    def read(batches):
        for batch in batches:
            for uri, number, places in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = BundleReader(uri)
                data = bundle.frame(number)
                yield _rows([parse_record(data, at)[0] for at in places])
                bundle.close()

    # A frame holds a bounded number of records, so the list of offsets is bounded too.
    frames = wanted.groupBy("bundle", "frame").agg(F.collect_list("frame_offset").alias("places"))
    return frames.mapInArrow(read, RECORD)


def archive(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Write all pages to fresh bundles in the shared folder; their index."""
    folder = work_path(pages.sparkSession, "warc")
    return write_bundles(with_originals(pages, params), folder, params)
