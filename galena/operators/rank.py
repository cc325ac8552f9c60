"""Weighted PageRank as a loop of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_by
from .resolve import with_ends


@dataclass(frozen=True)
class Ranking:
    ranks: DataFrame  # id, pagerank
    iterations: int
    converged: bool
    node_count: int
    edge_count: int


def overheated(nodes: DataFrame, files: int = 5) -> DataFrame:
    """Names that are defined in more than ``files`` files."""
    return nodes.groupBy("name").agg(F.count_distinct("file_path").alias("n_files")).where(F.col("n_files") > files)


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count("*").alias("out_degree"))


def weighted(nodes: DataFrame, edges: DataFrame, private: Column | None = None, files: int = 5) -> DataFrame:
    """source, target and weight, parallel edges summed: 1 / out-degree, a tenth of it to a private name and to an overheated one."""
    private = F.col("name").startswith("_") if private is None else private
    hot = overheated(nodes, files).select("name", F.lit(0.1).alias("hot"))
    factor = nodes.join(hot, "name", "left").select(F.col("id").alias("target"), (F.when(private, 0.1).otherwise(1.0) * F.coalesce("hot", F.lit(1.0))).alias("factor"))
    calls = with_ends(edges.where(F.col("kind") == "calls").select("source", "target"), nodes)
    summed = calls.groupBy("source", "target").agg(F.count("*").alias("n"))
    degree = summed.groupBy("source").agg(F.sum("n").alias("degree"))
    return summed.join(degree, "source").join(factor, "target").select("source", "target", (F.col("n") * F.col("factor") / F.col("degree")).alias("weight"), "n")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, epsilon: float = 1e-6, max_iterations: int = 100, private: Column | None = None, files: int = 5) -> Ranking:
    """Ranks by power iteration until the ranks change by less than ``epsilon`` together.

    Edges with weights below 1 / out-degree let mass go, and it isn't made up for. The edges are written once by source and
    the ranks lie by id, so a step shuffles only its sums by target, and is written to the shared folder.
    """
    names = cut(nodes.select("id", "name", "file_path"))
    n = names.count()
    if not n:
        return Ranking(names.select("id", F.lit(0.0).alias("pagerank")), 0, True, 0, 0)
    flow = cut_by(weighted(names, edges, private, files), "source")
    edge_count = flow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flow = flow.drop("n")
    dangling = cut(names.select("id").join(flow.select(F.col("source").alias("id")).distinct(), "id", "left_anti")).withColumn("dangling", F.lit(True))
    ranks = cut_by(names.select("id").join(dangling, "id", "left").select("id", F.coalesce("dangling", F.lit(False)).alias("dangling"), F.lit(1.0 / n).alias("pagerank")), "id")
    converged, done = False, 0
    if not edge_count:
        return Ranking(ranks.select("id", "pagerank"), 1, True, n, 0)
    loose = ranks.where("dangling").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
    for done in range(1, max_iterations + 1):
        inflow = flow.join(ranks.select(F.col("id").alias("source"), "pagerank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("pagerank") * F.col("weight")).alias("inflow"))
        base = (1 - damping) / n + damping * loose / n
        step = ranks.join(inflow, "id", "left").select("id", "dangling", F.col("pagerank").alias("old"), (F.lit(base) + damping * F.coalesce("inflow", F.lit(0.0))).alias("pagerank"))
        step = cut_by(step, "id")
        change, loose = step.agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0))).first()
        ranks = step.drop("old")
        if change < epsilon:
            converged = True
            break
    return Ranking(ranks.select("id", "pagerank"), done, converged, n, edge_count)


def written_back(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """nodes with the ranks; a node without one has 0."""
    columns = nodes.columns
    return nodes.drop("pagerank").join(ranks, "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))).select(columns)


def rank_of(nodes: DataFrame, node: str | int) -> float:
    """The rank of a node, 0 if there is none or it has none."""
    found = nodes.where(F.col("id") == node).select("pagerank").first()
    return found.pagerank or 0.0 if found else 0.0
