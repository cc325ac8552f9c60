"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of the whole text (the shuffle is the first partitioning). Each task reads its records
in id order into an open-addressing table that compares complete contents. When a table would hold more than ``budget``
bytes of distinct text, further unknown records go to ``FANOUT`` spill files by the next bits of the hash, and each file is
treated in the same way until its table fits; equal texts share all bits, so they always meet. Copies of a text that is in
the table take no room, so a group of any size passes. Spill files lie in the shared folder in a directory of the task
attempt's own, which is removed when the task ends; a retried task starts anew.

Defined results: of the rows with equal text the one with the lowest id is kept (null ids last; rows that tie are repeated
rows, of which one is kept). Empty text is a text like any other. A null text equals nothing: such rows are kept. Case,
blanks and normal forms count. Columns other than ``doc_id`` and ``text`` are carried along and don't matter.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, shared_dir, table

#: Bytes of distinct text in one table.
BUDGET = 96 << 20
FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Levels of partitioning; beyond these the bits of the hash are used up and a table takes what is left.
LEVELS = 12


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.tags: list[object] = []
        self.size = 0

    def place(self, h: int, content: bytes) -> tuple[int, int]:
        """The slot at which the search for the content ends, and the entry there or -1."""
        slots, mask = self.slots, len(self.slots) - 1
        i = (h ^ h >> 29) & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return i, e
            i = (i + 1) & mask
        return i, -1

    def add(self, slot: int, h: int, content: bytes, tag: object) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.tags.append(tag)
        self.size += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = array("q", [-1]) * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for e, x in enumerate(self.hashes):
                i = (x ^ x >> 29) & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = e


class Spill:
    """The spill files of one table that overflowed, by the next bits of the hash."""

    def __init__(self, files: fs.FileSystem, folder: str, schema: pa.Schema, level: int) -> None:
        self.files, self.schema, self.shift = files, schema, 62 - FANOUT_BITS * (level + 1)
        self.paths = [f"{folder}/{level}-{uuid.uuid4().hex}" for _ in range(FANOUT)]
        self.open: dict[int, tuple[pa.NativeFile, pa.RecordBatchWriter]] = {}

    def write(self, batch: pa.RecordBatch, rows: list[int], hashes: list[int]) -> None:
        by: dict[int, list[int]] = {}
        for r in rows:
            by.setdefault(hashes[r] >> self.shift & FANOUT - 1, []).append(r)
        for k, at in by.items():
            if k not in self.open:
                f = self.files.open_output_stream(self.paths[k])
                self.open[k] = f, pa.ipc.new_stream(f, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            self.open[k][1].write_batch(batch.take(pa.array(at)))

    def read(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for f, w in self.open.values():
            w.close()
            f.close()
        for k in self.open:
            with self.files.open_input_stream(self.paths[k]) as f:
                yield iter(pa.ipc.open_stream(f))
            self.files.delete_file(self.paths[k])


def grace(batches: Iterator[pa.RecordBatch], decide: Callable, text: str, key: str, tag: str, budget: int, uri: str) -> Iterator[pa.RecordBatch]:
    """``decide(batch, kept rows, copies, tags of their first ones)`` of each batch of one hash partition."""
    files, root = fs.FileSystem.from_uri(uri)
    folder = f"{root}/spill-{uuid.uuid4().hex}"
    made = False

    def run(source: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        nonlocal made
        found, spill = ContentTable(), None
        for batch in source:
            hashes, tags = batch.column(key).to_pylist(), batch.column(tag).to_pylist()
            contents = batch.column(text).cast(pa.binary() if pa.types.is_string(batch.column(text).type) else pa.large_binary())
            kept, copies, firsts, rest = [], [], [], []
            for r, h in enumerate(hashes):
                c = contents[r].as_py()
                if c is None:
                    kept.append(r)
                    continue
                slot, e = found.place(h, c)
                if e >= 0:
                    copies.append(r)
                    firsts.append(found.tags[e])
                elif level < LEVELS and found.hashes and (spill or found.size + len(c) > budget):
                    rest.append(r)
                    if spill is None:
                        if not made:
                            files.create_dir(folder)
                            made = True
                        spill = Spill(files, folder, batch.schema, level)
                else:
                    found.add(slot, h, c, tags[r])
                    kept.append(r)
            if rest:
                spill.write(batch, rest, hashes)
            yield from decide(batch, kept, copies, firsts)
        del found
        if spill:
            for part in spill.read():
                yield from run(part, level + 1)

    try:
        yield from run(batches, 0)
    finally:
        if made:
            files.delete_dir(folder)


def _partitioned(documents: DataFrame, key: str) -> DataFrame:
    """By a hash of the text, each partition in id order; null texts are spread by their ids."""
    h = F.when(F.col("text").isNull(), F.xxhash64(F.lit(1), "doc_id")).otherwise(F.xxhash64("text"))
    return bounded(documents).withColumn(key, h).repartition(F.col(key)).sortWithinPartitions(F.col("doc_id").asc_nulls_last())


def keep_first(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of documents without the later copies, with their columns."""
    key = fresh(documents.columns, "content_hash")
    uri = shared_dir(documents.sparkSession)

    def kept(batch: pa.RecordBatch, rows: list[int], copies: list[int], firsts: list) -> Iterator[pa.RecordBatch]:
        if rows:
            out = batch.take(pa.array(rows)) if copies or len(rows) < batch.num_rows else batch
            yield out.select([n for n in out.schema.names if n != key])

    run = lambda batches: grace(batches, kept, "text", key, "doc_id", budget, uri)
    return _partitioned(documents, key).mapInArrow(run, documents.schema)


def copies(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Of each row that is a later copy: doc_id and kept_id, the id of the row that is kept."""
    uri = shared_dir(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def pairs(batch: pa.RecordBatch, rows: list[int], copied: list[int], firsts: list) -> Iterator[pa.RecordBatch]:
        if copied:
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(copied)), pa.array(firsts, ids.type)], ["doc_id", "kept_id"])

    run = lambda batches: grace(batches, pairs, "text", "content_hash", "doc_id", budget, uri)
    return _partitioned(documents.select("doc_id", "text"), "content_hash").mapInArrow(run, f"doc_id {kind}, kept_id {kind}")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, kept_id FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS kept_id, row_number() OVER w AS place
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
) WHERE place > 1
"""
