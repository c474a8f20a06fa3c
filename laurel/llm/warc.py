"""Zstandard-compressed WARC archives: writer and reader.

An archive begins with a skippable frame that holds a dictionary; then every record is one frame of its own, packed
with that dictionary. The reader loads the dictionary from the leading frame, unpacks frame by frame in bounded
memory and checks each record: version line, mandatory headers, lengths, end of record, digests.

Payloads that occur more than once are kept by the record with the smallest page id; the others
are revisit records that refer to it. Digests decide which payloads are equal.

Archives are written by the tasks that hold the pages, below the shared folder, and rolled over at a bounded size.
Each attempt of a task writes files of its own; the stored manifest names those that count, so a repeated task
leaves orphans but no doubles. Files are reached through pyarrow's file systems.

Defined cases: null and empty pages have an empty payload. Rows with equal payload and the same, smallest id are
responses all of them, and so are rows whose payload only has null ids. Null urls and ids are marked as such and read
back as null. An empty table gives an empty result. Only the columns page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import batches_of, utf8, written
from laurel.session import scratch_path

VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 16 * 1024
DICTIONARY_PAGES = 200  # pages a task's dictionary is trained on
ARCHIVE_BYTES = 8 << 20
READ_BYTES = 8 << 20  # archive bytes that a reading task gets on average
RECORD_ID = "urn:laurel:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD_ID}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="~:/?#[]@!$&'()*+,;=")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>"), ("WARC-Profile", REVISIT)]
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in headers)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, separator, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not separator:
        raise WarcError(f"not a record: {raw[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or name in headers:
            raise WarcError(f"bad header line: {line!r}")
        headers[name] = value.strip()
    missing = [name for name in MANDATORY if name not in headers]
    if missing:
        raise WarcError(f"missing headers: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"record length differs from Content-Length {headers['Content-Length']}")
    return headers, rest[:-4]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload in a record (empty for a revisit) and the length of the full payload."""
    http, separator, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
    if not separator or not fields.get(b"Content-Length", b"").isdigit():
        raise WarcError("bad HTTP header in the block")
    size = int(fields[b"Content-Length"])
    if headers["WARC-Type"] == "response":
        if len(payload) != size:
            raise WarcError(f"payload has {len(payload)} bytes, {size} announced")
        if f"sha1:{digest(payload)}" != headers.get("WARC-Payload-Digest"):
            raise WarcError("payload digest differs")
    return payload, size


class Archive:
    """Builds one archive in memory, up to a bounded size."""

    def __init__(self, dictionary: zstandard.ZstdCompressionDict | None) -> None:
        self.buffer, self.records = io.BytesIO(), 0
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            content = dictionary.as_bytes()
            self.buffer.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)

    def add(self, raw: bytes) -> None:
        self.buffer.write(self.packer.compress(raw))
        self.records += 1


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; None where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def records_of(stream) -> Iterator[bytes]:
    """The raw records of an archive, one frame after the other."""
    held = stream.read(8)
    dictionary = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", held[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise WarcError("the dictionary frame is cut off")
        if len(content) >= 4 and struct.unpack("<I", content[:4])[0] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
        held = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    raise WarcError("the last frame is cut off")
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as error:
                raise WarcError(f"bad frame: {error}") from error
            held = frame.unused_data
        yield b"".join(parts)


MANIFEST = "path string, records bigint, bytes bigint"
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write_archives(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        context = TaskContext.get()
        prefix = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    yield record(*(value.as_py() for value in row))

        def stored() -> Iterator[tuple[str, int, int]]:
            source, samples = records(), []
            for raw in source:
                samples.append(raw)
                if len(samples) == DICTIONARY_PAGES:
                    break
            dictionary, archive, number = train(samples), None, 0
            for raw in (r for part in (samples, source) for r in part):
                archive = archive or Archive(dictionary)
                archive.add(raw)
                if archive.buffer.tell() >= ARCHIVE_BYTES:
                    yield store(archive, number)
                    archive, number = None, number + 1
            if archive:
                yield store(archive, number)

        def store(archive: Archive, number: int) -> tuple[str, int, int]:
            name = f"{prefix}-{number:04d}.warc.zst"
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(archive.buffer.getbuffer())
            return f"{folder}/{name}", archive.records, archive.buffer.tell()

        return batches_of(stored(), _MANIFEST, 64)

    return write


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and refers_to (null for a response) of every page."""
    keyed = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("sha1", F.sha1("payload"))
    kept = keyed.groupBy("sha1").agg(F.min("page_id").alias("kept_id"))
    other = (F.col("page_id") > F.col("kept_id")) | (F.col("page_id").isNull() & F.col("kept_id").isNotNull())
    kept = written(kept, "warc-kept")  # stored, so that Spark can split a payload with very many pages
    return keyed.join(kept, "sha1").select("page_id", "url", "payload", F.when(other, F.col("kept_id")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes a record for every page; returns the manifest (path, records, bytes) of the archives."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return written(with_roles(pages).mapInArrow(_write_archives(folder), MANIFEST), "warc-manifest")


RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _page(reference: str | None) -> int | None:
    if reference is None:
        return None
    if not reference.startswith(f"<{RECORD_ID}") or not reference.endswith(">"):
        raise WarcError(f"unknown record id {reference}")
    number = reference[len(RECORD_ID) + 1 : -1]
    return None if number == "null" else int(number)


def _read_archives(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    files, name = pafs.FileSystem.from_uri(path)
                    count = 0
                    with files.open_input_stream(name) as stream:
                        for raw in records_of(stream):
                            headers, block = parse(raw)
                            payload, size = payload_of(headers, block)
                            uri = headers.get("WARC-Target-URI")
                            count += 1
                            yield (
                                _page(headers["WARC-Record-ID"]), None if uri is None else unquote(uri),
                                payload if with_payload else None, size,
                                headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                headers["WARC-Type"], _page(headers.get("WARC-Refers-To")),
                            )
                    if count != expected:
                        raise WarcError(f"{path} has {count} records, {expected} announced")

        return batches_of(rows(), _RECORDS, 256)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives that the manifest names, read back and validated."""
    n_bytes = manifest.agg(F.sum("bytes")).first()[0] or 0
    spread = manifest.select("path", "records").repartition(n_bytes // READ_BYTES + 1, "path")  # as many tasks as the bytes ask for
    return spread.mapInArrow(_read_archives(with_payload), RECORDS)
