"""Containment joins and the resolution of references to call edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import places

#: Lines a bin: points and spans of one file meet in bins, so that a long file isn't all pairs of its lines and symbols.
BIN = 128


def innermost(points: DataFrame, symbols: DataFrame, key: str = "ref_id", order: str = "id") -> DataFrame:
    """Of each point (key, file_path, line) the id of the smallest symbol around it, null outside all; the key tells points apart.

    Smallest by lines, then by offsets, then by start and ``order``. File and bin of lines make it a hash join with the range
    as residual. Of symbols that cover the same lines of a bin only the smallest is joined, and every line is asked once, so
    the pairs of a bin don't grow with the symbols and points that share its lines.
    """
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), (F.col("end_byte") - F.col("start_byte")).alias("bytes"), "start_byte", F.col(order).alias("o"), "id")
    s = _binned(symbols.select(F.col("file_path").alias("f"), "start_line", "end_line", size.alias("size")), "start_line", "end_line")
    s = s.groupBy("f", "bin", F.greatest("start_line", F.col("bin") * BIN).alias("first"), F.least("end_line", F.col("bin") * BIN + BIN - 1).alias("last")).agg(F.min("size").alias("size"))
    around = (F.col("file_path") == F.col("f")) & (F.floor(F.col("line") / BIN) == F.col("bin")) & F.col("line").between(F.col("first"), F.col("last"))
    found = points.select("file_path", "line").distinct().join(s, around).groupBy("file_path", "line").agg(F.min("size")["id"].alias("from_node_id"))
    return points.join(found, ["file_path", "line"], "left").select(key, "from_node_id")


def _binned(spans: DataFrame, first: str, last: str, name: str = "bin") -> DataFrame:
    """Each span once in each bin of lines that it touches; without lines, or if it ends before it starts, nowhere."""
    bins = F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))
    return spans.where(F.col(first) <= F.col(last)).withColumn(name, F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Pairs of ids of line ranges (id, file_path, start_line, end_line) of one file that overlap."""
    x = _binned(left.select(F.col("id").alias(a), "file_path", F.col("start_line").alias("s1"), F.col("end_line").alias("e1")), "s1", "e1", "bin1")
    y = _binned(right.select(F.col("id").alias(b), F.col("file_path").alias("f2"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2")), "s2", "e2", "bin2")
    # a pair meets in every bin that both touch and counts in the first of them
    once = F.col("bin1") == F.floor(F.greatest("s1", "s2") / BIN)
    return x.join(y, (F.col("file_path") == F.col("f2")) & (F.col("bin1") == F.col("bin2")) & once & (F.col("s1") <= F.col("e2")) & (F.col("e1") >= F.col("s2"))).select(a, b)


def scopes(spans: DataFrame) -> DataFrame:
    """id and scope, the ids of all spans (id, file_path, start_line, end_line) strictly around it, outermost first; none without any."""
    s = spans.select("file_path", "id", "start_line", "end_line")
    o = _binned(s.select(F.col("file_path").alias("f"), F.col("id").alias("outer_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e")), "s", "e")
    inside = (F.col("file_path") == F.col("f")) & (F.floor(F.col("start_line") / BIN) == F.col("bin")) & (F.col("s") <= F.col("start_line")) & (F.col("e") >= F.col("end_line"))
    strictly = (F.col("s") < F.col("start_line")) | (F.col("e") > F.col("end_line"))
    found = s.join(o, inside & strictly).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("e"), "outer_id"))).alias("o"))
    return found.select("id", F.transform("o", lambda x: x["outer_id"]).alias("scope"))


def _first(nodes: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """One id for each key, by order: an aggregate, so that partial minima shrink the shuffle."""
    return nodes.groupBy(*keys).agg(F.min(F.struct(*order, "id"))["id"].alias(name))


def targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with target_id: the first symbol of that name and language in the same file, else in any file."""
    named = nodes.select("id", F.col("name").alias("reference_name"), "file_path", "language", "start_line")
    same = _first(named, ["reference_name", "file_path", "language"], ["start_line"], "same_id")
    any_ = _first(named, ["reference_name", "language"], ["file_path", "start_line"], "any_id")
    found = refs.join(same, ["reference_name", "file_path", "language"], "left").join(any_, ["reference_name", "language"], "left")
    return found.withColumn("target_id", F.coalesce("same_id", "any_id")).drop("same_id", "any_id")


def resolve(refs: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new call edges, and one row with the numbers of resolved and unresolved references.

    References outside every symbol make no edge and are skipped; those that repeat an edge (source, target, line) count as
    resolved, once each, but make it once. An edge that exists isn't made again. The edges' ids continue by file, line,
    source and target.
    """
    placed = targets(refs, nodes)
    inside = F.col("from_node_id").isNotNull()
    stats = placed.agg(F.count_if(inside & F.col("target_id").isNotNull()).alias("resolved"), F.count_if(inside & F.col("target_id").isNull()).alias("unresolved"))
    edges = placed.where(inside & F.col("target_id").isNotNull()).select("file_path", F.col("from_node_id").alias("source"), F.col("target_id").alias("target"), F.lit("calls").alias("kind"), "line", F.col("col"))
    edges = edges.groupBy("source", "target", "kind", "line").agg(F.min("file_path").alias("file_path"), F.min("col").alias("col"))
    if existing is not None:
        edges = edges.join(existing.select("source", "target", "kind", "line"), ["source", "target", "kind", "line"], "left_anti")
    return edges.withColumn("provenance", F.lit("heuristic")), stats


def numbered(edges: DataFrame, first: int | Column = 1) -> DataFrame:
    """edges with edge_id in the order of file, line, source and target.

    The sort is by ranges and the numbers are the offset of the range and the place in it, so no single task sees all.
    """
    found = places(edges, "edge_id", *map(F.col, ("file_path", "line", "source", "target")))
    return found.withColumn("edge_id", (F.col("edge_id") - 1 + first).cast("bigint")).drop("file_path")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, kind, line); a missing line is like -1, and stays as the first edge has it."""
    first = F.min(F.struct("edge_id", "line"))
    found = edges.groupBy("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("key")).agg(first.alias("first"))
    return found.select("source", "target", "kind", "first.line", "first.edge_id")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
