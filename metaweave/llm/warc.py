"""WARC archives: one gzip member per record, read back sequentially.

Writing: records of equal payload (SHA-256, at least ``least`` bytes) are written in full
once, for the smallest page_id; the others become ``revisit`` records that name it.  Each
task writes archives below the shared folder and rolls to a new one after ``roll`` bytes;
a file gets its final name only when complete, so a lost task leaves nothing that counts
and its repetition writes the same names.  The manifest (one row an archive) says which
files there are.

Reading: an archive is inflated incrementally, one gzip member at a time with a block of
at most ``READ`` bytes in hand, the header block is parsed, the body is framed by its
Content-Length and the block and payload digests are verified while it streams.  A damaged
record raises a ValueError that names the file and the offset.

Defined cases: a null payload counts as empty; payloads below ``least`` bytes are always
``response``; a null page_id is written without one and never stands for others unless all
of its group lack one (such copies are all responses); a null url is left out and line breaks
in it are percent-encoded; repeated rows: the first by (page_id, place in the table) is the
response and the others revisit it; an
empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm.common import LOCATOR, hot_join, known_by, slices, with_locator
from metaweave.plans.scratch import cut, scratch_path

LEAST = 100
ROLL = 64 << 20
READ = 1 << 16
#: Tasks that read archives back, at most; each archive is read by one.
READERS = 1 << 14
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry this time unless the pages say otherwise.
DATE = "2024-01-01T00:00:00Z"

_URN = 0x6D657461776561766500000000000000 & ~((1 << 64) - 1)


def record_id(page_id: int | None) -> str:
    """A URN that holds the page id in its low 64 bits; a fresh one without an id."""
    if page_id is None:
        return uuid.uuid4().urn
    return uuid.UUID(int=_URN | (page_id & (1 << 64) - 1)).urn


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>")).int
    if value & ~((1 << 64) - 1) != _URN:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >= 1 << 63 else low


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member of its own."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    http_length: int
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = field(default=None, repr=False)

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


class _Members:
    """The members of a gzip stream, each inflated block by block."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held, self.offset = stream, b"", 0

    def more(self) -> bool:
        if not self.held:
            self.held = self.stream.read(READ)
        return bool(self.held)

    def member(self) -> Iterator[bytes]:
        gz = zlib.decompressobj(31)
        while not gz.eof:
            data = gz.unconsumed_tail
            if not data:
                self.more()
                data, self.held = self.held, b""
                self.offset += len(data)
            out = gz.decompress(data, READ)
            if out:
                yield out
            elif not data and not gz.eof:
                raise ValueError("the archive ends within a record")
        self.held = gz.unused_data + self.held
        self.offset -= len(gz.unused_data)


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode().partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream: BinaryIO, with_payload: bool = False) -> Iterator[Record]:
    """Every record in order, verified."""
    members = _Members(stream)
    while members.more():
        start = members.offset
        blocks = members.member()

        def until(mark: bytes, held: bytes) -> tuple[bytes, bytes]:
            while (at := held.find(mark)) < 0:
                block = next(blocks, None)
                if block is None:
                    raise ValueError(f"a record at {start} ends within its headers")
                held += block
            return held[:at], held[at + len(mark) :]

        head, rest = until(b"\r\n\r\n", b"")
        first, *lines = head.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        headers = _headers(lines)
        left = int(headers["content-length"])
        whole, body = hashlib.sha256(), hashlib.sha256()
        kept: list[bytes] = []
        http_head, size = b"", 0
        in_body = False

        def take(data: bytes) -> None:
            nonlocal http_head, in_body, size
            whole.update(data)
            if not in_body:
                http_head += data
                at = http_head.find(b"\r\n\r\n")
                if at < 0:
                    return
                data, http_head, in_body = http_head[at + 4 :], http_head[:at], True
            body.update(data)
            size += len(data)
            if with_payload:
                kept.append(data)

        data: bytes | None = rest
        tail = b""
        while True:
            take(data[:left])
            tail += data[left:]
            left -= min(left, len(data))
            data = next(blocks, None)
            if data is None:
                break
        if left or tail != b"\r\n\r\n":
            raise ValueError(f"the record at {start} doesn't have its Content-Length")
        if headers.get("warc-block-digest") != f"sha256:{whole.hexdigest()}":
            raise ValueError(f"the record at {start} fails its block digest")
        http = _headers(http_head.split(b"\r\n")[1:])
        said = headers["warc-payload-digest"].partition(":")[2]
        length = int(http["content-length"])
        if headers["warc-type"] == "response" and (said != body.hexdigest() or length != size):
            raise ValueError(f"the record at {start} fails its payload digest")
        yield Record(start, headers, length, size, said, b"".join(kept) if with_payload else None)


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, digest, first``: ``first`` is set for revisits.

    Digests are grouped without the payloads, which stay where they are unless there are more
    revisits than a task can hold a list of.
    """
    located = with_locator(pages)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = cut(located.where(F.octet_length(raw) >= least).select(*LOCATOR, "page_id", F.sha2(raw, 256).alias("digest")), "digests")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", *LOCATOR)
    firsts = narrow.groupBy("digest").agg(F.min(rank).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = hot_join(narrow.select(*LOCATOR, "digest"), cut(firsts, "firsts"), "digest")
    again = again.where(" OR ".join(f"stays.{c} <> {c}" for c in LOCATOR)).select(*LOCATOR, F.col("stays.page_id").alias("first"))
    decided = known_by(located.select(*LOCATOR, "page_id", "url", "html"), cut(again, "revisits"), LOCATOR, "left")
    return decided.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"), "first")


def _local(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_archives(decided: DataFrame, out_dir: str, roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns their manifest ``(path, records, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = _local(out_dir)
        store.create_dir(base, recursive=True)
        number, out, name, path, records, size = 0, None, "", "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(name, path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/part-{part:06d}-{number:04d}.warc.gz"
                    name = f"{path}.{uuid.uuid4().hex}.open"
                    out, records, size = store.open_output_stream(name, compression=None), 0, 0
                    number += 1
                coded = encode_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["first"])
                out.write(coded)
                records += 1
                size += len(coded)
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return decided.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "path string, records bigint, bytes bigint")


READ_SCHEMA = (
    "archive string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string"
)


def read_archives(manifest: DataFrame, out_dir: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives that the manifest (a written table) names, a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _local(out_dir)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, seen, held = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for r in read_records(stream, with_payload):
                            url = r.headers.get("warc-target-uri")
                            refers = r.headers.get("warc-refers-to")
                            rows.append(
                                {
                                    "archive": path,
                                    "offset": r.offset,
                                    "page_id": page_of(r.headers["warc-record-id"]),
                                    "url": url,
                                    "record_type": r.kind,
                                    "refers_to": refers and page_of(refers),
                                    "payload_bytes": r.http_length,
                                    "payload_digest": r.payload_digest,
                                }
                                | ({"payload": r.payload} if with_payload else {})
                            )
                            seen += 1
                            held += len(r.payload or b"")
                            if len(rows) >= 4096 or held >= 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                                rows, held = [], 0
                    except (zlib.error, KeyError, ValueError) as error:
                        raise ValueError(f"{path}: {error}") from error
                if seen != records:
                    raise ValueError(f"{path} has {seen} records; the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    fields = [
        ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
    shape = pa.schema(fields + ([("payload", pa.binary())] if with_payload else []))
    archives = max(1, min(manifest.count(), READERS))
    files = manifest.select("path", "records").repartitionByRange(archives, "path")
    return files.mapInArrow(run, READ_SCHEMA + (", payload binary" if with_payload else ""))


def round_trip(spark: SparkSession, pages: DataFrame, out_dir: str | None = None, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` as archives below ``out_dir`` and read every record back."""
    out_dir = out_dir or scratch_path(spark, "warc")
    manifest = cut(write_archives(decide(pages, least), out_dir, roll), "manifest")
    return read_archives(manifest, out_dir)
