"""BM25 over substrings, expansion over the call graph, and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import occurrences, query_words
from ..schema import MAX_DEPTH, RRF_K, SEED_NODES
from ..session import bounded, cut, places, small_side
from .graph import hops
from .observe import top_in_file
from .resolve import overlapping

K1, B = 1.2, 0.75


def recall_size(top_k: int) -> int:
    return min(3 * top_k, 60)


def grams(chunks: DataFrame, body: str = "body") -> DataFrame:
    """gram and ids: by block of chunks (id, a text of its own) each distinct run of three characters, whatever its case, with the ids of the chunks that hold it.

    A chunk without three characters has none. The runs of a block are numbers, sorted once in Python, so that a row is a
    run of a block and not one of a chunk."""
    ids = chunks.schema["id"].dataType
    arrow = to_arrow_schema(T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(ids))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column("low").to_pylist()
            size = np.array([len(t) for t in low])
            codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
            if len(codes) < 3:
                continue
            chunk = np.repeat(np.arange(len(low), dtype=np.uint64), size)
            inside = chunk[:-2] == chunk[2:]
            each, starts, chunk = _runs(codes, chunk, inside)
            text = np.stack([each >> np.uint64(42), each >> np.uint64(21) & np.uint64(0x1FFFFF), each & np.uint64(0x1FFFFF)], 1).astype(np.uint32)
            texts = text.tobytes().decode("utf-32-le")
            found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(chunk)).astype(np.int32)), b.column("id").take(pa.array(chunk.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array([texts[k : k + 3] for k in range(0, len(texts), 3)], pa.string()), found.cast(arrow.field("ids").type)], schema=arrow)

    return bounded(chunks.where(F.length(body) >= 3).select("id", F.lower(F.col(body)).alias("low"))).mapInArrow(run, f"gram string, ids array<{ids.simpleString()}>")


def _runs(codes: np.ndarray, chunk: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of three characters that are inside of a chunk (21 bits a character), where the chunks of each begin, and these chunks, each once a run.

    The characters of a block are few, so that a run of their numbers and its chunk are one number, and sorting these is
    much faster than finding their order. Where a block has so many that the number is too long, the order is found."""
    there = np.zeros(0x110000, bool)
    there[codes] = True
    letters = np.flatnonzero(there).astype(np.uint64)
    b, c = (np.uint64(max(int(n) - 1, 1).bit_length()) for n in (len(letters), chunk[-1] + np.uint64(1)))
    if short := 3 * b + c <= 64:
        numbers = np.zeros(0x110000, np.uint64)
        numbers[letters.astype(np.int64)] = np.arange(len(letters), dtype=np.uint64)
        codes = numbers[codes]
    else:
        codes, b = codes.astype(np.uint64), np.uint64(21)
    runs = (codes[:-2] << (b + b) | codes[1:-1] << b | codes[2:])[inside]
    chunk = chunk[:-2][inside]
    if short:
        runs <<= c
        runs |= chunk
        runs.sort()
        chunk = runs & (np.uint64(1) << c) - np.uint64(1)
        runs >>= c
    else:
        # stable, so the chunks of a run stay in their order and a repeated pair stands beside its like
        order = np.argsort(runs, kind="stable")
        runs, chunk = runs[order], chunk[order]
    first = np.append(True, runs[1:] != runs[:-1])[: len(runs)]
    kept = first | np.append(True, chunk[1:] != chunk[:-1])[: len(runs)]
    runs, chunk, first = runs[kept], chunk[kept], first[kept]
    starts = np.flatnonzero(first)
    each = runs[starts]
    if short:
        low = (np.uint64(1) << b) - np.uint64(1)
        each = letters[each >> (b + b)] << np.uint64(42) | letters[each >> b & low] << np.uint64(21) | letters[each & low]
    return each, starts, chunk


def postings(chunks: DataFrame, body: str = "body") -> DataFrame:
    """The inverted index: gram and ids of each block of chunks (``grams``).

    Each part of it is sorted by gram, so that the runs of a query read little of it; the blocks split the most frequent.
    Parts go by hash: for ranges all texts would be taken apart twice, first for the sample that the ranges are made of."""
    return grams(chunks, body).repartition("gram", F.col("ids")[0]).sortWithinPartitions("gram")


def _holding(index: DataFrame, words: list[str]) -> DataFrame:
    """id of the chunks that hold every run of three characters of some words: all that can hold the words."""
    grams = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})
    rows = index.where(F.col("gram").isin(grams))
    if "ids" in index.columns:  # an index that was stored before blocks has a row a chunk
        rows = rows.select(F.explode("ids").alias("id"))
    found = rows.groupBy("id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(grams)).select("id")


def bm25(chunks: DataFrame, query: str, limit: int | None = None, body: str = "body", index: DataFrame | None = None) -> DataFrame:
    """id, score (higher is better) and bm25_rank of the chunks that hold every word of the query.

    A word is held as a substring, whatever its case; words of less than three characters don't count, and without any
    other nothing is found. One pass counts the chunks of each word and the mean length, a second scores the chunks that
    pass; ties go by id. With an index (``postings``) of the chunks only those that may hold a word are read for it; the mean
    length is still that of all.
    """
    words = [w for w in query_words(query) if len(w) >= 3] if len(query.strip()) >= 2 else []
    if not words:
        return chunks.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("bm25_rank")).limit(0)
    low, size = F.lower(F.col(body)), F.greatest(F.length(body) - 2, F.lit(0))
    distinct = list(dict.fromkeys(words))
    counts = [F.count_if(F.contains(low, F.lit(w))).alias(f"n{k}") for k, w in enumerate(distinct)]
    if index is None:
        seen = chunks.agg(F.count("*").alias("n"), F.sum(size).alias("size"), *counts).first()
    else:
        sizes = chunks.agg(F.count("*").alias("n"), F.sum(size).alias("size"))
        each = reduce(DataFrame.unionAll, (_holding(index, [w]) for w in distinct)).distinct()
        seen = sizes.crossJoin(chunks.join(small_side(cut(each)), "id", "left_semi").agg(*counts)).first()
        chunks = chunks.join(small_side(cut(_holding(index, distinct))), "id", "left_semi")
    if not seen.n or not seen["size"] or not all(seen[f"n{k}"] for k in range(len(distinct))):
        return chunks.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("bm25_rank")).limit(0)
    norm = K1 * (1 - B + B * size / (float(seen["size"]) / seen.n))
    score = F.lit(0.0)
    for k, w in enumerate(distinct):
        idf = math.log((seen.n - seen[f"n{k}"] + 0.5) / (seen[f"n{k}"] + 0.5))
        tf = occurrences(F.col("low"), w)
        score = score + F.lit(words.count(w) * (idf if idf > 0 else 1e-6)) * tf * (K1 + 1) / (tf + F.col("norm"))
    holding = chunks.where(reduce(Column.__and__, (F.contains(low, F.lit(w)) for w in distinct)))
    scored = holding.select("id", low.alias("low"), norm.alias("norm")).select("id", score.alias("score"))
    if limit is None:
        return scored.withColumn("bm25_rank", F.lit(None).cast("int"))
    best = scored.orderBy(F.col("score").desc(), "id").limit(limit)
    return best.withColumn("bm25_rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")))


def seed_nodes(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, cap: int = SEED_NODES) -> DataFrame:
    """The first ``cap`` nodes that overlap hits: by rank of the hit, then size of the node, then start."""
    found = chunks.join(F.broadcast(hits.select("id", "bm25_rank")), "id")
    pairs = overlapping(found, nodes, "chunk", "node").join(hits.select(F.col("id").alias("chunk"), "bm25_rank"), "chunk")
    sized = pairs.join(nodes.select(F.col("id").alias("node"), (F.col("end_line") - F.col("start_line")).alias("span"), "start_line"), "node")
    first = sized.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("bm25_rank", "span", "start_line")).alias("o"))
    return first.orderBy("o", "id").limit(cap).select("id")


def graph_ranks(reached: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, hop and graph_rank of the chunks that overlap reached nodes (id, hop): by hop, rank of the node, start and id."""
    there = nodes.join(small_side(reached), "id")
    pairs = overlapping(chunks, there, "chunk", "node").join(there.select(F.col("id").alias("node"), "hop", "pagerank"), "node")
    best = pairs.groupBy(F.col("chunk").alias("id")).agg(F.min(F.struct("hop", (-F.col("pagerank")).alias("minus"))).alias("b"))
    placed = best.join(chunks.select("id", "start_line"), "id").select("id", F.col("b.hop").alias("hop"), (-F.col("b.minus")).alias("pagerank"), "start_line")
    ranked = places(placed, "graph_rank", F.col("hop"), F.col("pagerank").desc(), F.col("start_line"), F.col("id"))
    return ranked.select("id", "hop", F.col("graph_rank").cast("int").alias("graph_rank"))


def fuse(by_text: DataFrame, by_graph: DataFrame, text_weight: float = 1.0, graph_weight: float = 1.0) -> DataFrame:
    """id, both ranks and rrf of the chunks that either list has."""
    both = by_text.join(by_graph, "id", "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", part(text_weight, "bm25_rank") + part(graph_weight, "graph_rank"))


def search(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, top_k: int = 20, text_weight: float = 1.0, graph_weight: float = 1.0, depth: int = 1, index: DataFrame | None = None) -> DataFrame:
    """The top_k fused chunks with their scores, hop and related nodes, best first.

    The graph is asked from the hits only, so without a hit there is nothing; with depth 0 there are the hits alone.
    """
    fused = search_debug(chunks, nodes, edges, query, top_k, text_weight, graph_weight, depth, index)
    order = [F.col("rrf").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("graph_rank").asc_nulls_last()]
    best = fused.orderBy(*order).limit(top_k)
    best = cut(best)  # top_k rows
    told = cut(chunks.select("id", "file_path", "language", "start_line", "end_line", "body").join(F.broadcast(best), "id"))
    files = F.broadcast(told.select("file_path").distinct())
    told = told.join(F.broadcast(top_in_file(nodes.join(files, "file_path", "left_semi"))), "file_path", "left")
    return told.withColumn("vector", F.lit(0.0)).orderBy(*order)


def search_debug(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, top_k: int = 20, text_weight: float = 1.0, graph_weight: float = 1.0, depth: int = 1, index: DataFrame | None = None) -> DataFrame:
    """Every fused chunk with score, both ranks (null where it isn't in a list), hop and rrf."""
    hits = cut(bm25(chunks, query, recall_size(top_k), index=index))
    depth = max(0, min(MAX_DEPTH, depth))
    if depth == 0 or hits.isEmpty():
        by_graph = hits.select("id", F.lit(0).alias("hop"), F.lit(0).alias("graph_rank")).limit(0)
    else:
        reached = hops(edges, cut(seed_nodes(hits, chunks, nodes)), depth)
        by_graph = graph_ranks(cut(reached), chunks, nodes)
    return fuse(hits, by_graph, text_weight, graph_weight).withColumn("score", F.coalesce("score", F.lit(0.0)))
