"""WARC archives compressed record by record with a dictionary that each archive carries itself.

An archive starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds a dictionary built
from its own first records; every record follows as a frame of its own, so any can be read alone.
Records with equal payloads are written once: the one of the smallest id is a response, the others
are revisits that refer to it. Archives are written under the name of their partition, by way of a
name of the attempt, so a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_path

MAGIC = 0x184D2A5D
LEVEL = 3
#: Dictionary size, and how much of an archive's records it is built from.
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 6 << 20
#: An archive is closed once its records exceed this size before compression.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:loamgrid:page:"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields of a record (lower-case names), its kind and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    page = lambda x: None if x is None or x.endswith("none>") else int(x[1:-1].removeprefix(_ID))
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"],
        "refers_to": page(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None,
    }


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; of records too few or too small to train on, their plain content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one archive to an open binary file."""

    def __init__(self, sink):
        self.sink, self.waiting, self.size, self.packer = sink, [], 0, None
        self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.size += len(raw)
        if self.packer:
            self.sink.write(self.packer.compress(raw))
        else:
            self.waiting.append(raw)
            if self.size >= SAMPLE_BYTES:
                self._start()

    def _start(self) -> None:
        own = dictionary([x[: 128 << 10] for x in self.waiting])
        own.precompute_compress(level=LEVEL)
        content = own.as_bytes()
        self.sink.write(struct.pack("<II", MAGIC, len(content)) + content)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        for raw in self.waiting:
            self.sink.write(self.packer.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if not self.packer:
            self._start()


def read_records(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive from an open binary file, frame by frame, in bounded memory."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with its dictionary")
    content = source.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == struct.pack("<I", 0xEC30A437) else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    rest = b""
    while rest or (rest := source.read(chunk)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(chunk)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into archives below ``folder``; returns the manifest (path, records, bytes).

    ``folder`` is a URI that driver and executors share."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    typed = rows.join(groups.select("sha1", "first"), "sha1", "left")
    typed = typed.withColumn("refers_to", F.when((F.octet_length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        part, attempt, done = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        writer = None

        def finish() -> None:
            writer.close()
            writer.sink.close()
            name = f"{base}/part-{part:06d}-{len(done):04d}.warc.zst"
            files.move(f"{base}/.{attempt}", name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", writer.records, writer.size))

        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(n) for n in ("page_id", "url", "payload", "sha1", "refers_to"))):
                if writer is None:
                    writer = ArchiveWriter(files.open_output_stream(f"{base}/.{attempt}", compression=None))
                writer.add(record(page_id.as_py(), url.as_py(), payload.as_py(), sha1.as_py(), refers_to.as_py()))
                if writer.size >= ARCHIVE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    # sorted, so that a repeated task writes the same archive
    return settle(typed.sortWithinPartitions("page_id").select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_SQL = {"page_id": "bigint", "url": "string", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "payload": "binary"}


def read_archives(manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives that a manifest lists, one row each; ``columns`` picks fields."""
    names = columns or list(_FIELDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, base = _open(path)
                with files.open_input_stream(base, compression=None) as source:
                    rows, size = [], 0
                    for raw in read_records(source):
                        rows.append({n: v for n, v in parse(raw).items() if n in names})
                        size += len(raw) if "payload" in names else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, _FIELDS[n]) for n in names]))
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, _FIELDS[n]) for n in names]))

    count = manifest.count()
    return manifest.select("path").repartition(max(1, count)).mapInArrow(read, ", ".join(f"{n} {_SQL[n]}" for n in names))


def archive_and_read(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages in the shared folder, then read the archives back, a row per page.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null page is empty,
    a null url has no header, a null ``page_id`` never counts as the smallest and is a revisit where
    an equal payload has an id. Rows of equal payload that share the smallest ``page_id`` are all
    responses. An empty table gives no archive and no rows; other columns are ignored.
    """
    manifest = write_archives(pages, shared_path(pages.sparkSession, "warc"), min_revisit_bytes)
    return read_archives(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
