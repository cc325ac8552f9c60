"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame a record.

``read_archives`` reads files one a task at a time, frame after frame, so that memory holds one record. A skippable frame at
the start whose magic number is ``DICTIONARY`` holds the dictionary, itself compressed or not; skippable frames elsewhere are
passed over. Each record is checked: the version line, a well-formed header, the mandatory fields, and that the block has the
length of Content-Length and is followed by two line breaks and nothing else.

Defined results: a record that fails a check is a row with ``error`` set and the fields that could be read; a frame that
can't be decoded, or is cut off, is a row with ``error`` and ends its file, as the next frame can't be found; an empty file
has no rows; a Content-Length of more than 18 digits and a record of more than ``RECORD_BYTES`` are errors; a file that can't be opened fails the job. A block that
isn't UTF-8 is read as Latin-1 by ``text_of``. ``write_archives`` writes a null url without the field and a null
page as an empty block; repeated rows and null ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, scratch, table

DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
CHUNK = 1 << 18
#: Bytes of records after which a writer begins a new archive.
ARCHIVE_BYTES = 1 << 30
DICTIONARY_BYTES = 1 << 15
DICTIONARY_RECORDS = 256
#: Bytes of a record beyond which it isn't kept in memory but told as an error, and bytes that are decoded at once.
RECORD_BYTES = 1 << 30
STEP = 1 << 14
LENGTH = re.compile("[0-9]{1,18}")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class Frames:
    """The frames of an archive."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.buffer, self.at = source, b"", 0

    def need(self, n: int) -> bytes:
        """At least n bytes of what comes next, or all that is left."""
        while len(self.buffer) < n and (more := self.source.read(max(CHUNK, n - len(self.buffer)))):
            self.buffer += more
        return self.buffer

    def take(self, n: int) -> bytes:
        out, self.buffer = self.need(n)[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def __iter__(self) -> Iterator[tuple[int, bytes | None, str | None]]:
        """Offset and content of each frame; on a failure None and the reason."""
        decoder = zstandard.ZstdDecompressor()
        while head := self.need(8)[:8]:
            start = self.at
            if len(head) == 8 and (magic := struct.unpack("<I", head[:4])[0]) in SKIPPABLE:
                size = struct.unpack("<I", head[4:])[0]
                content = self.take(8 + size)[8:]
                if len(content) < size:
                    yield start, None, "a skippable frame is cut off"
                    return
                if start == 0 and magic == DICTIONARY:
                    try:
                        if content[:4] == FRAME_MAGIC:
                            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                    except (zstandard.ZstdError, MemoryError):
                        yield start, None, "the dictionary can't be loaded"
                        return
                continue
            if head[:4] != FRAME_MAGIC:
                yield start, None, "no frame begins here"
                return
            frame, out, size = decoder.decompressobj(), [], 0
            try:
                while not frame.eof and (data := self.need(1)[:STEP]):
                    part = frame.decompress(data)
                    size += len(part)
                    out = [] if size > RECORD_BYTES else out
                    out.append(part)
                    self.take(len(data) - (len(frame.unused_data) if frame.eof else 0))
            except zstandard.ZstdError as e:
                yield start, None, f"a frame can't be decoded: {e}"
                return
            if not frame.eof:
                yield start, None, "a frame is cut off"
                return
            if size > RECORD_BYTES:
                yield start, None, f"a record of {size} bytes is larger than {RECORD_BYTES}"
            else:
                yield start, b"".join(out), None


def parse(record: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """The header fields by lower-cased name, the block and what is wrong."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return {}, None, "no version line"
    if not mark:
        return {}, None, "the header doesn't end"
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            fields[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        name = key.strip().lower()
        if not colon or not name or any(c.isspace() for c in name):
            return fields, None, "a header line isn't a field"
        fields.setdefault(name, value.strip())
    if missing := [f for f in MANDATORY if f not in fields]:
        return fields, None, "without " + ", ".join(missing)
    if not LENGTH.fullmatch(fields["content-length"]):
        return fields, None, "Content-Length isn't a number of at most 18 digits"
    length = int(fields["content-length"])
    if len(rest) < length:
        return fields, rest, f"the block has {len(rest)} of {length} bytes"
    if rest[length:] != b"\r\n\r\n":
        return fields, rest[:length], "the block doesn't end where Content-Length says"
    return fields, rest[:length], None


def record(kind: str, record_id: str, date: str, block: bytes, uri: str | None = None, content_type: str | None = None) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archive(to: BinaryIO, records: Iterator[bytes], most: int = ARCHIVE_BYTES) -> bool:
    """Write records until there are no more or ``most`` bytes of them are written; whether any were."""
    first = []
    for r in records:
        first.append(r)
        if len(first) == DICTIONARY_RECORDS:
            break
    if not first:
        return False
    encoder = zstandard.ZstdCompressor(level=3)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r for r in first if len(r) <= CHUNK] or first, level=3)
        packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        to.write(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        encoder = zstandard.ZstdCompressor(level=3, dict_data=trained)
    except zstandard.ZstdError:
        pass  # too little to train on: the archive has no dictionary
    size = 0
    for r in first:
        to.write(encoder.compress(r))
        size += len(r)
    while size < most and (r := next(records, None)) is not None:
        to.write(encoder.compress(r))
        size += len(r)
    return True


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives below the shared folder; their paths. A path is listed once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    yield record("resource", f"<urn:page:{'' if page is None else page}>", "2024-01-01T00:00:00Z", (html or "").encode(), url, "text/html; charset=utf-8")

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        source = records()
        while True:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as f:
                some = write_archive(f, source)
            if not some:
                files.delete_file(f"{root}/{name}")
                return
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    spark = pages.sparkSession
    bounded(pages).select("page_id", "url", "html").mapInArrow(run, "path string").write.parquet(f"{folder}-list")
    return spark.read.parquet(f"{folder}-list")


FIELDS = pa.schema([("path", pa.string()), ("place", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
ROW = "path string, place bigint, type string, record_id string, date string, uri string, content_type string, content_length bigint, block binary, error string"
BATCH_BYTES = 4 << 20


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the archives in column ``path``: file, offset of the frame, header fields, block and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as f:
                    for start, content, error in Frames(f):
                        fields, block = {}, None
                        if content is not None:
                            fields, block, error = parse(content)
                        length = fields.get("content-length", "")
                        rows.append((path, start, *(fields.get(k) for k in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-type")), int(length) if LENGTH.fullmatch(length) else None, block, error))
                        size += len(block or b"")
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)

    return paths.select("path").mapInArrow(run, ROW)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of a folder's archives; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return found.select("path")


def text_of(block: Column) -> Column:
    """A block as text: UTF-8, or where it isn't that Latin-1, in which every byte is a character."""
    text = block.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(block, "ISO-8859-1"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives in the shared folder and read from these."""
    paths = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    # a file is a task's work, whatever the size of the list
    files = max(1, paths.count())
    found = read_archives(paths.repartition(min(files, 10_000), "path"))
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).cast("bigint")
    return found.select(page.alias("page_id"), F.col("uri").alias("url"), F.col("content_length"), text_of(F.col("block")).alias("html"), "error")


OP5_SQL = "SELECT page_id, url, octet_length(encode(html)) AS content_length, html, NULL::VARCHAR AS error FROM pages"
