"""Walks over call edges: callers, callees, impact, hops and induced subgraphs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ascii_lower
from ..schema import DRILL_CAP, LAYER_CAP
from ..session import cut, small_side
from .observe import with_defaults
from .resolve import distinct_edges


@dataclass(frozen=True)
class Walk:
    nodes: DataFrame  # id, depth
    edges: DataFrame  # source, target, kind, line, edge_id
    truncated: bool

    def layers(self, nodes: DataFrame) -> DataFrame:
        """The rows of the nodes with their depth: layer after layer, in each by start line and id."""
        return with_defaults(nodes).join(small_side(self.nodes), "id").orderBy("depth", "start_line", "id")


def calls(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "calls")


def known(nodes: DataFrame, start: str | int) -> None:
    """An error unless there is such a node."""
    if nodes.where(F.col("id") == start).isEmpty():
        raise ValueError(f"unknown node id: {start}")


def resolve_id(nodes: DataFrame, name: str) -> str | int:
    """The id that a text stands for: 16 hexadecimal digits are taken as an id, else the least id of a node of that name."""
    if re.fullmatch("[0-9a-f]{16}", name):
        return name
    found = nodes.where(F.col("name") == name).agg(F.min("id")).first()[0]
    if found is None:
        raise ValueError(f"no symbol is called {name}")
    return found


def scope(qualified: Column) -> Column:
    """What stands before the last ``::``, with it; empty without one."""
    return F.regexp_extract(qualified, r"^((?s:.*)::)", 1)


def siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """sibling and k: once each symbol of the same file below the scope of any of the nodes ``of`` (id, k), itself and nested ones too, with the least k of these.

    A node outside any scope has none. Case of ASCII letters doesn't count. Scopes meet, each once however many symbols are
    in it: what is below a scope is so because its own scope is that one or begins with it.
    """
    inside = nodes.select("id", "file_path", scope(F.col("qualified_name")).alias("own")).where("own <> ''")
    low = ascii_lower(F.col("own"))
    changed = cut(inside.join(of.select("id", "k"), "id").groupBy("file_path", low.alias("scope")).agg(F.min("k").alias("k")))
    ends = F.filter(F.sequence(F.lit(2), F.length(low)), lambda i: F.substring(low, i - 1, F.lit(2)) == "::")
    around = F.transform(ends, lambda i: F.substring(low, F.lit(1), i))
    scopes = inside.select("file_path", "own").distinct().select("file_path", "own", F.explode(around).alias("scope"))
    below = cut(scopes.join(small_side(changed), ["file_path", "scope"]).groupBy("file_path", "own").agg(F.min("k").alias("k")))
    return inside.withColumnRenamed("id", "sibling").join(small_side(below), ["file_path", "own"]).groupBy("sibling").agg(F.min("k").alias("k"))


def walk(edges: DataFrame, start: str | int | DataFrame, depth: int, reverse: bool = True, cap: int | None = LAYER_CAP, nodes: DataFrame | None = None) -> Walk:
    """Callers (reverse) or callees within ``depth`` steps of a node, or of any of several (id); an error if ``nodes`` are given and it isn't one.

    A layer takes its first ``cap`` new nodes in the order of their edges' ids; the edges to the others are dropped. Edges to
    nodes that were there before are kept. Edges that say the same are one.
    """
    if nodes is not None and not isinstance(start, DataFrame):
        known(nodes, start)
    near, far = ("target", "source") if reverse else ("source", "target")
    links = calls(edges)
    spark = edges.sparkSession
    kind = links.schema[far].dataType
    visited = _begin(spark, start, kind.simpleString())
    frontier, found, truncated = visited, [], False
    for d in range(1, depth + 1):
        step = cut(links.join(small_side(frontier.select(F.col("id").alias(near))), near, "left_semi"))
        new = step.join(small_side(visited.select(F.col("id").alias(far))), far, "left_anti").groupBy(F.col(far).alias("id")).agg(F.min("edge_id").alias("first"))
        if cap is not None:
            ordered = cut(new.orderBy("first", "id").limit(cap + 1))
            truncated = truncated or ordered.count() > cap
            new = ordered.orderBy("first", "id").limit(cap)
        new = cut(new.select("id", F.lit(d).alias("depth")))
        reached = visited.select("id").unionAll(new.select("id"))
        found.append(step.join(small_side(reached.withColumnRenamed("id", far)), far, "left_semi").select(links.columns) if cap is not None else step.select(links.columns))
        if new.isEmpty():
            break
        visited = cut(visited.unionAll(new))
        frontier = new
    return Walk(visited, distinct_edges(_together(found, links)), truncated)


def _begin(spark: SparkSession, start: str | int | DataFrame, kind: str) -> DataFrame:
    if isinstance(start, DataFrame):
        return cut(start.select("id", F.lit(0).alias("depth")).distinct())
    return spark.createDataFrame([(start, 0)], f"id {kind}, depth int")


def _together(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts) if parts else like.limit(0)


def impact(nodes: DataFrame, edges: DataFrame, start: str | int | DataFrame, depth: int = 3, cap: int | None = DRILL_CAP) -> Walk:
    """What a change of a node, or of any of several (id), may touch: its callers and, in each layer, the siblings of those in a scope and their callers.

    The start's own siblings count to the first layer, with their callers. Siblings are of all nodes that a layer has when
    it begins, also of those reached before, not of those the siblings bring in; one that is there already brings nothing.
    With a cap a layer grows by drilling down until it has ``cap`` nodes: through its nodes in the order in which their
    edges come, their siblings by start line and id, and the callers of these by edge; a layer that is as large without it
    isn't cut, but is told as truncated.
    """
    if not isinstance(start, DataFrame):
        known(nodes, start)
    links = calls(edges)
    spark = edges.sparkSession
    kind = links.schema["source"].dataType.simpleString()
    visited = _begin(spark, start, kind)
    frontier, found, truncated = visited.select("id"), [], False
    first = cut(siblings(nodes, frontier.withColumn("k", F.lit(0))).select(F.col("sibling").alias("id")))
    for d in range(1, depth + 1):
        seeds = frontier.unionAll(first).distinct() if d == 1 else frontier
        step = links.join(small_side(seeds.select(F.col("id").alias("target"))), "target", "left_semi").select(links.columns)
        layer = step.groupBy(F.col("source").alias("id")).agg(F.min("edge_id").alias("came"))
        if d == 1:
            layer = layer.unionByName(first.join(layer, "id", "left_anti").withColumn("came", F.lit(None).cast("bigint")))
        layer = cut(layer)
        found.append(step)
        if cap is None:
            beside = siblings(nodes, layer.withColumn("k", F.lit(0))).select(F.col("sibling").alias("id"))
            for there in (visited, layer):
                beside = beside.join(small_side(there.select("id")), "id", "left_anti")
            beside = cut(beside)
            callers = links.join(small_side(beside.select(F.col("id").alias("target"))), "target", "left_semi").select(links.columns)
            found.append(callers)
            layer = layer.select("id").unionAll(beside).unionAll(callers.select(F.col("source").alias("id"))).distinct()
        else:
            ids, some, over = _drill(nodes, links, layer, visited, cap)
            truncated = truncated or over
            layer = layer.select("id") if ids is None else spark.createDataFrame([(i,) for i in ids], f"id {kind}")
            found.append(some.select(links.columns))
        new = cut(layer.join(small_side(visited.select("id")), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        if new.isEmpty():
            break
        visited = cut(visited.unionAll(new))
        frontier = new.select("id")
    return Walk(visited, distinct_edges(_together(found, links)), truncated)


def _drill(nodes: DataFrame, links: DataFrame, layer: DataFrame, visited: DataFrame, cap: int) -> tuple[list | None, DataFrame, bool]:
    """The capped drill-down, whose order decides: on the driver, over what can take room, which ``cap`` bounds.

    The ids of the layer (None: as it is), the edges that were read, and whether something was left out. Edges from nodes
    that are visited or in the layer take no room and all come with their sibling."""
    size = layer.count()
    if size >= cap:
        return None, links.limit(0), True
    order = W.orderBy(F.col("came").asc_nulls_last(), "start_line", "id")
    placed = layer.join(nodes.select("id", "start_line"), "id", "left").withColumn("k", F.row_number().over(order))
    placed = cut(placed.select("id", "k"))
    have = {r.id for r in placed.collect()}
    # a sibling counts where it comes first; fewer than cap are taken as new and fewer than cap come as callers of others
    other = siblings(nodes, placed)
    for there in (visited, placed):
        other = other.join(small_side(there.select(F.col("id").alias("sibling"))), "sibling", "left_anti")
    first = other.join(nodes.select(F.col("id").alias("sibling"), "start_line"), "sibling")
    new_siblings = {r.sibling: r.k for r in first.orderBy("k", "start_line", "sibling").limit(2 * cap + 1).collect()}
    callers: dict = {}
    if new_siblings:
        some = links.sparkSession.createDataFrame([(x,) for x in new_siblings], f"target {links.schema['target'].dataType.simpleString()}")
        # only sources that are new take room: the first edges of the first cap + 1 of them decide, whatever lies between
        new = links.join(F.broadcast(some), "target", "left_semi")
        for there in (visited, placed):
            new = new.join(small_side(there.select(F.col("id").alias("source"))), "source", "left_anti")
        place = F.row_number().over(W.partitionBy("target").orderBy("edge_id", "source"))
        new = new.groupBy("target", "source").agg(F.min("edge_id").alias("edge_id")).withColumn("place", place)
        for r in new.where(F.col("place") <= 2 * cap + 1).collect():
            callers.setdefault(r.target, []).append((r.edge_id, r.source))
    whole, part, over = [], F.lit(False), False
    for sibling, k in new_siblings.items():
        if sibling in have:
            continue
        if len(have) >= cap:
            over = True
            break
        have.add(sibling)
        for edge, source in sorted(callers.get(sibling, [])):
            if source not in have:
                if len(have) >= cap:
                    over = True
                    part = (F.col("target") == sibling) & ((F.col("edge_id") < edge) | ((F.col("edge_id") == edge) & (F.col("source") < source)))
                    break
                have.add(source)
        else:
            whole.append(sibling)
            # full before the last node of the layer: the rest isn't drilled into
            over = over or len(have) >= cap and k < size
        if over:
            break
    return list(have), links.where(F.col("target").isin(whole) | part), over


def _files(nodes: DataFrame, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """file_path of the reached nodes (id) that isn't one of the seeds'."""
    return nodes.join(reached.select("id").distinct(), "id", "left_semi").select("file_path").distinct().join(seeds.select("file_path"), "file_path", "left_anti")


def touched_files(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """file_path of the files beyond the seeds (file_path) that a change of these may touch: one walk from all their nodes, without caps."""
    start = nodes.join(seeds.select("file_path"), "file_path", "left_semi").select("id")
    return _files(nodes, impact(nodes, edges, start, depth, cap=None).nodes, seeds)


def neighbouring_files(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, related: list, depth: int) -> DataFrame:
    """file_path of the files beyond the seeds (file_path) of callers and callees of their nodes and of related ones, without caps."""
    start = nodes.join(seeds.select("file_path"), "file_path", "left_semi").select("id")
    if related:
        start = start.unionByName(nodes.where(F.col("id").isin(related)).select("id"))
    both = [walk(edges, start, depth, reverse, None).nodes for reverse in (True, False)]
    return _files(nodes, both[0].unionByName(both[1]), seeds)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """id and hit of the seeds (id) and their callers and callees within ``depth`` steps: whether it is a seed."""
    both = [walk(edges, seeds, depth, reverse, None).nodes for reverse in (True, False)]
    return both[0].unionByName(both[1]).groupBy("id").agg((F.min("depth") == 0).alias("hit"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id and hop: the fewest steps from any seed (id), along callers only or callees only; a seed counts from other seeds."""
    links = calls(edges).select("source", "target").distinct()
    spark_seeds = seeds.select(F.col("id").alias("seed"), F.col("id").alias("id")).distinct()
    every = None
    for near, far in (("target", "source"), ("source", "target")):
        visited = frontier = cut(spark_seeds.withColumn("hop", F.lit(0)))
        for d in range(1, depth + 1):
            step = links.join(small_side(frontier.select("seed", F.col("id").alias(near))), near).select("seed", F.col(far).alias("id")).distinct()
            frontier = cut(step.join(visited.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(d)))
            visited = cut(visited.unionByName(frontier))
        every = visited if every is None else every.unionByName(visited)
    return every.where(F.col("seed") != F.col("id")).groupBy("id").agg(F.min("hop").alias("hop"))


def induced(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n highest nodes and the edges of all kinds between them."""
    top = cut(nodes.orderBy(F.col("pagerank").desc(), "id").limit(max(1, n)))
    ids = top.select("id")
    inside = edges.join(small_side(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(small_side(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    return top, inside.select(edges.columns)


def graph_data(nodes: DataFrame, edges: DataFrame, n: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The n highest nodes, the edges between them, and one row: max_pagerank of these, total nodes and whether there are more."""
    top, inside = induced(nodes, edges, n)
    one = top.agg(F.coalesce(F.max("pagerank"), F.lit(0.0)).alias("max_pagerank"), F.count("*").alias("shown"))
    told = one.crossJoin(nodes.agg(F.count("*").alias("total")))
    return top, inside, told.select("max_pagerank", "total", (F.col("total") > F.col("shown")).alias("truncated"))
