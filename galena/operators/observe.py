"""Counts, health, languages, treemap and overviews of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ancestors
from ..schema import STATUSES
from ..session import before_ranges, in_ranges


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    found = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        found = one if found is None else found.crossJoin(one)
    return found


def health(files: DataFrame) -> DataFrame:
    """One row: files by parse status, 0 where there are none."""
    return files.agg(*(F.count_if(F.col("parse_status") == s).alias(s) for s in STATUSES))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "language")


def tokens_by_file(chunks: DataFrame) -> DataFrame:
    """Tokens of each file, most first."""
    summed = chunks.groupBy("file_path").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    return summed.orderBy(F.col("tokens").desc(), "file_path")


def treemap(file_tokens: DataFrame) -> DataFrame:
    """path, parent, depth, is_leaf, tokens and share of the whole for each file and folder (the root is the empty path)."""
    each = file_tokens.select("tokens", F.explode(ancestors(F.col("file_path"))).alias("a")).select("tokens", "a.*")
    summed = each.groupBy("path", "parent", "depth").agg(F.max("is_leaf").alias("is_leaf"), F.sum("tokens").alias("tokens"))
    whole = file_tokens.agg(F.sum("tokens").alias("whole"))
    return summed.crossJoin(F.broadcast(whole)).select("path", "parent", "depth", "is_leaf", "tokens", (F.col("tokens") / F.col("whole")).alias("share"))


def file_importance(nodes: DataFrame) -> DataFrame:
    """The largest rank in each file: one central symbol makes a file important."""
    return nodes.groupBy("file_path").agg(F.max("pagerank").alias("importance"))


def with_defaults(nodes: DataFrame) -> DataFrame:
    """nodes with 0 for missing lines, offsets and ranks and an empty text for a missing language or kind; the rest stays null."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("start_line", "end_line", "start_byte", "end_byte", "pagerank") if c in nodes.columns}
    return nodes.withColumns(zero | {c: F.coalesce(F.col(c), F.lit("")) for c in ("language", "kind") if c in nodes.columns})


def node_detail(nodes: DataFrame, node: Column) -> DataFrame:
    """The row of a node with its place among all ranks."""
    one = nodes.where(F.col("id") == node)
    above = nodes.select(F.col("pagerank").alias("other")).join(F.broadcast(one.select(F.col("pagerank").alias("own"))), F.col("other") > F.col("own"))
    return one.crossJoin(above.agg((F.count("*") + 1).alias("rank"))).crossJoin(nodes.agg(F.count("*").alias("of")))


def global_rank(nodes: DataFrame) -> DataFrame:
    """id and rank, one more than the number of higher ranks, of every node.

    Ranks come from the counts of distinct values, so that only these are in one sequence, summed by ranges.
    """
    by = nodes.groupBy("pagerank").agg(F.count("*").alias("n"))
    ranged = in_ranges(by, F.col("pagerank").desc())
    before = before_ranges(ranged, F.col("n"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy(F.col("pagerank").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("inside", inside).join(before, "part").select("pagerank", (F.col("before") + F.col("inside") + 1).alias("rank"))
    return nodes.join(ranks, "pagerank").select("id", "pagerank", "rank")


def top_nodes(nodes: DataFrame, n: int, file_path: str | None = None) -> DataFrame:
    """The n highest nodes, at least one, of all or of one file."""
    if file_path is not None:
        nodes = nodes.where(F.col("file_path") == file_path)
    return with_defaults(nodes).orderBy(F.col("pagerank").desc(), "id").limit(max(1, n))


def top_in_file(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The ids of each file's k highest nodes, in order."""
    place = F.row_number().over(W.partitionBy("file_path").orderBy(F.col("pagerank").desc(), "start_line", "id"))
    best = nodes.withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("related_nodes"))


def top_leaves(file_tokens: DataFrame, n: int = 10) -> DataFrame:
    """The n files of most tokens."""
    return file_tokens.orderBy(F.col("tokens").desc(), "file_path").limit(n)


def overview(files: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sizes, health, when it was last indexed and the number of languages."""
    of_files = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"), F.count_distinct("language").alias("languages"), *(F.count_if(F.col("parse_status") == s).alias(s) for s in STATUSES))
    of_edges = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("provenance") == "scip").alias("scip_edges"))
    of_nodes = nodes.agg(F.count("*").alias("symbols"), F.count_if(F.col("pagerank") > 0).alias("ranked_symbols"))
    of_chunks = chunks.agg(F.count("*").alias("chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    return of_files.crossJoin(of_nodes).crossJoin(of_edges).crossJoin(of_chunks)
