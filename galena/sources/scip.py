"""Import of SCIP indexes: protobuf files of occurrences and relationships of symbols, as call edges.

A file is decoded by the wire format of the few fields that count, document by document, in the tasks; the rest are joins.
Lines of SCIP count from 0, those of nodes from 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.resolve import innermost
from ..session import cut, small_side

DEFINITION = 1
SINGLE_LINE, MULTI_LINE = 8, 9
OCCURRENCE = [("symbol", pa.string()), ("roles", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]
RELATION = [("symbol", pa.string()), ("target", pa.string()), ("is_reference", pa.bool_()), ("is_implementation", pa.bool_())]
DOCUMENTS = pa.schema([("doc", pa.int32()), ("file_path", pa.string()), ("occurrences", pa.list_(pa.struct(OCCURRENCE))), ("relations", pa.list_(pa.struct(RELATION)))])
DDL = "doc int, file_path string, occurrences array<struct<symbol string, roles int, first int, last int>>, relations array<struct<symbol string, target string, is_reference boolean, is_implementation boolean>>"


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is longer than 64 bits")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of each field of a message: a number, or the bytes of a text, message or packed list."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(data, at)
            yield number, value
        elif wire in (1, 2, 5):
            if wire == 2:
                size, at = varint(data, at)
            else:
                size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("a field is cut off")
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {wire}")


def signed(value: int) -> int:
    value &= (1 << 32) - 1
    return value - (1 << 32) if value >> 31 else value


def numbers(value: int | memoryview) -> list[int]:
    if isinstance(value, int):
        return [signed(value)]
    out, at = [], 0
    while at < len(value):
        x, at = varint(value, at)
        out.append(signed(x))
    return out


def line_range(by_number: dict[int, int], several: bool) -> tuple[int, int]:
    first = signed(by_number.get(1, 0))
    return first, signed(by_number.get(3, 0)) if several else first


def occurrence(data: memoryview) -> dict:
    """symbol, roles and first and last line (None without a range); typed ranges go before lists of 3 or 4 numbers."""
    out, plain, typed = {"symbol": "", "roles": 0, "first": None, "last": None}, [], None
    for number, value in fields(data):
        if number == 1:
            plain += numbers(value)
        elif number == 2:
            out["symbol"] = str(value, "utf-8", "replace")
        elif number == 3:
            out["roles"] = signed(value)
        elif number in (SINGLE_LINE, MULTI_LINE):
            typed = line_range({n: v for n, v in fields(value) if isinstance(v, int)}, number == MULTI_LINE)
    if typed:
        out["first"], out["last"] = typed
    elif len(plain) >= 3:
        out["first"], out["last"] = plain[0], plain[2] if len(plain) >= 4 else plain[0]
    return out


def relations(data: memoryview) -> list[dict]:
    symbol, found = "", []
    for number, value in fields(data):
        if number == 1:
            symbol = str(value, "utf-8", "replace")
        elif number == 4:
            one = {"target": "", "is_reference": False, "is_implementation": False}
            for n, v in fields(value):
                if n == 1:
                    one["target"] = str(v, "utf-8", "replace")
                elif n in (2, 3):
                    one["is_reference" if n == 2 else "is_implementation"] = bool(v)
            found.append(one)
    return [{"symbol": symbol, **r} for r in found]


def decode(data: bytes) -> Iterator[dict]:
    """The documents of an index."""
    place = 0
    for number, value in fields(memoryview(data)):
        if number != 2:
            continue
        doc = {"doc": place, "file_path": "", "occurrences": [], "relations": []}
        for n, v in fields(value):
            if n == 1:
                doc["file_path"] = str(v, "utf-8", "replace").replace("\\", "/")
            elif n == 2:
                doc["occurrences"].append(occurrence(v))
            elif n == 3:
                doc["relations"] += relations(v)
        place += 1
        yield doc


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc, file_path, occurrences and relations of each document of the .scip files at a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for doc in decode(content.as_py()):
                    yield pa.RecordBatch.from_pylist([doc], schema=DOCUMENTS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, DDL)


def symbol_name(symbol: Column) -> Column:
    """The bare name of the last descriptor of a SCIP symbol, empty without one.

    Without the four words of scheme and package, parts in backticks, the suffix (``().``, ``[]``, ``#``, ``/``, ``.``), a
    disambiguator in brackets, and quotes."""
    plain = F.regexp_replace(F.regexp_replace(symbol, r"^(?:[^ ]* ){4}", "\x00"), "`[^`]*`", "")
    descriptor = F.when(F.startswith(plain, F.lit("\x00")), F.substring(plain, 2, 1 << 30)).otherwise("")
    opened = F.contains(descriptor, F.lit("("))
    # up to the last bracket; else without the brackets or the mark at the end
    head = F.when(opened, F.regexp_extract(descriptor, r"^((?s:.*))\(", 1)).otherwise(F.regexp_replace(descriptor, r"(?:\[\]|[#/.])$", ""))
    last = F.trim(F.regexp_extract(head, r"((?s:[^#/.]*))$", 1))
    bare = F.when(opened, F.regexp_replace(last, r"(?s)\(.*$", "")).otherwise(last)
    return F.regexp_replace(bare, "^[\"']+|[\"']+$", "")


@dataclass(frozen=True)
class Imported:
    edges: DataFrame  # source, target, kind, line and provenance of the new edges
    kept: DataFrame  # the edges that were there, without the heuristic ones that the new replace
    stats: DataFrame  # one row: documents, occurrences, relationships, edges_inserted, edges_replaced


def _targets(nodes: DataFrame) -> DataFrame:
    """By name the first node by file, line and id, of any language."""
    return nodes.groupBy(F.col("name").alias("target_name")).agg(F.min(F.struct("file_path", "start_line", "id"))["id"].alias("target"))


def _sources(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (file_path, def_line from 0 or null, symbol) with source: the node that starts there, else the first of that name in the file."""
    by_line = nodes.groupBy("file_path", (F.col("start_line") - 1).alias("def_line")).agg(F.min("id").alias("by_line"))
    by_name = nodes.groupBy("file_path", F.col("name").alias("source_name")).agg(F.min(F.struct("start_line", "id"))["id"].alias("by_name"))
    named = asked.withColumn("source_name", symbol_name(F.col("symbol")))
    found = named.join(by_line, ["file_path", "def_line"], "left").join(by_name, ["file_path", "source_name"], "left")
    return found.withColumn("source", F.coalesce("by_line", "by_name")).drop("by_line", "by_name", "source_name")


def import_index(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> Imported:
    """The edges that an index (``read_index``) adds to those of nodes.

    A relationship that is a reference or an implementation makes an edge from the node of its symbol's definition; an
    occurrence that isn't a definition one from the innermost definition around its line (of equal ones the first). Local
    symbols define nothing. An edge (source, target, line) is made once, for the first document that has it. A file that
    gets an edge loses its heuristic ones; others keep theirs. An error without nodes.
    """
    each = documents.select("doc", "file_path", F.posexplode("occurrences").alias("place", "o")).select("doc", "file_path", "place", "o.*")
    related = documents.select("doc", "file_path", F.explode("relations").alias("r")).select("doc", "file_path", "r.*")
    counted = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("occurrences")), F.lit(0)).alias("occurrences"), F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("relationships"))
    return import_rows(each, related, counted, nodes, edges)


def import_rows(each: DataFrame, related: DataFrame, counted: DataFrame, nodes: DataFrame, edges: DataFrame) -> Imported:
    """``import_index`` of documents in rows, so that no document needs to be one value.

    ``each`` has the occurrences (doc, file_path, symbol, roles, first, last) with their place, any value that orders those
    of a document; ``related`` the relations with their doc and file_path; ``counted`` one row: documents, occurrences and
    relationships."""
    if nodes.isEmpty():
        raise ValueError("no nodes: index before importing")
    defines = F.col("roles").bitwiseAND(DEFINITION) != 0
    definitions = each.where(defines & ~F.startswith("symbol", F.lit("local ")) & F.col("first").isNotNull())
    lines = definitions.groupBy("doc", "symbol").agg(F.min_by("first", "place").alias("def_line"))

    related = related.where("is_reference or is_implementation").join(lines, ["doc", "symbol"], "left")
    by_relation = _sources(related, nodes).select("doc", "file_path", "source", F.col("target").alias("target_symbol"), (F.col("def_line") + 1).alias("line"))

    # definitions as spans and references as points of their document
    spans = definitions.select(F.col("doc").alias("file_path"), F.struct("symbol", F.col("first").alias("def_line")).alias("id"), F.col("first").alias("start_line"), F.col("last").alias("end_line"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), "place")
    # references to one symbol from one line make the same edge
    points = each.where(~defines & F.col("first").isNotNull()).select("doc", "file_path", "symbol", "first").distinct()
    points = points.select(F.struct("doc", "file_path", "symbol", "first").alias("ref_id"), F.col("doc").alias("file_path"), F.col("first").alias("line"))
    around = innermost(points, spans, order="place").where("from_node_id is not null")
    asked = around.select("ref_id.doc", "ref_id.file_path", F.col("ref_id.symbol").alias("target_symbol"), F.col("ref_id.first").alias("at"), F.col("from_node_id.symbol").alias("symbol"), F.col("from_node_id.def_line").alias("def_line"))
    by_occurrence = _sources(asked, nodes).select("doc", "file_path", "source", "target_symbol", (F.col("at") + 1).alias("line"))

    pending = by_relation.unionByName(by_occurrence).where("source is not null").withColumn("target_name", symbol_name(F.col("target_symbol")))
    pending = pending.where("target_name <> ''").join(_targets(nodes), "target_name")
    # written, as the new edges are needed themselves, by file and for their number
    new = cut(pending.groupBy("source", "target", "line").agg(F.min(F.struct("doc", "file_path"))["file_path"].alias("file_path")))
    covered = new.select("file_path").distinct()
    inside = nodes.join(small_side(covered), "file_path", "left_semi").select(F.col("id").alias("source"), F.lit(True).alias("covered"))
    marked = edges.join(small_side(inside), "source", "left").withColumn("gone", F.coalesce("covered", F.lit(False)) & (F.col("provenance") == "heuristic"))
    kept = marked.where(~F.col("gone")).select(edges.columns)
    made = new.select("source", "target", F.lit("calls").alias("kind"), F.col("line").cast("int").alias("line"), F.lit("scip").alias("provenance"))
    stats = counted.crossJoin(made.agg(F.count("*").alias("edges_inserted"))).crossJoin(marked.agg(F.count_if("gone").alias("edges_replaced")))
    return Imported(made, kept, stats)
