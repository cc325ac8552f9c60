"""Near-duplicates by 128-bit SimHash with pigeonring filtering.

A fingerprint is the sign of the sum, over the distinct words of a text, of the words' 128 hashed signs. Two texts are near
duplicates if their fingerprints differ in at most ``TAU`` = 15 bits. The 128 bits form a ring of ``BOXES`` = 16 segments of 8
bits. By the pigeonring principle a pair within TAU has a segment from which every chain of l consecutive segments differs
in at most floor(l * TAU / BOXES) = l - 1 bits together: none in the first, one in the first two, and so on. So at each of
the 16 starts the points that agree in the first segment are a group, of 1/256 of them on average; a group of more than
``GROUP_POINTS`` is split by the next segment as well, into which each of its points goes with no and with each single bit
changed, and so again by the third (with what is left of its budget). In a group, points meet that agree in the next
segment up to the budget of its chain (in a large group, the next two); these candidates must meet the budgets of the chains
up to 8 segments before the full Hamming check. That is exact: it finds every pair within TAU, without a cap on partners or
candidates.

Equal fingerprints are one point, joined to its lowest id, so thousands of copies cost no pairs. A group passes on a tree
for each of its components and the number of links of each point, a link being counted at the first start that finds it.
Classes are the connected components; the lowest id of each stays.

Two texts of n distinct words that share a part j of them (Jaccard) differ in about 128 / pi * acos(2 j / (1 + j)) bits, so TAU finds
most pairs above j = 0.88, whatever their length; of a short text a single changed word is a larger part, so of texts of 30
words only copies with one or two changed words are found.

Defined results: null texts, texts without a letter or digit and null ids have no fingerprint and are in no group, as is a
document without near duplicate. Rows that share an id are one document, which is in the group of any of them. Ids are
cast to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, cut, small_side, table

TAU = 15
BOXES = 16
WIDTH = 8
HALF = 64 // WIDTH
#: Points of a group beyond which it is split by its next segment, up to MOST_SEGMENTS of them, and beyond which candidates
#: must agree in two more segments rather than one.
GROUP_POINTS = 1 << 21
MOST_SEGMENTS = 3
DEEP_POINTS = 1 << 16
#: Candidates that are compared at once.
PAIRS = 1 << 18


def simhash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints as two columns of 64 bits, and which texts have a word."""
    out, some = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    for i, j in kernels.slices(texts):
        at, h = kernels.words(texts[i:j])
        if not len(h):
            continue
        # the first place of each word of a text
        first = ~pd.Series(kernels.mix64(h + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
        at, h = at[first], h[first]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        which, count = at[starts], np.diff(starts, append=len(at))
        signs = np.stack([kernels.mix64(h), kernels.mix64(h ^ np.uint64(0xD6E8FEB86659FD93))], 1)
        # eight bits are added at once, a byte each, over runs of at most 255 words
        bits = np.unpackbits(signs.view(np.uint8), axis=1).view(np.uint64)
        runs = np.flatnonzero((np.arange(len(at)) - np.repeat(starts, count)) % 255 == 0)
        sums = np.add.reduceat(bits, runs, axis=0).view(np.uint8)
        ones = np.add.reduceat(sums, np.searchsorted(runs, starts), axis=0, dtype=np.int32)
        out[i + which] = np.packbits(2 * ones > count[:, None], axis=1).view(np.uint64)
        some[i + which] = True
    return out, some


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, hi and lo of the documents that have a fingerprint."""

    @F.pandas_udf("hi bigint, lo bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            bits, some = simhash(texts.fillna("").tolist())
            found = pd.DataFrame(bits.view(np.int64), columns=["hi", "lo"]).astype("Int64")
            found[~some] = pd.NA
            yield found

    found = bounded(documents).where("doc_id is not null and text is not null").select("doc_id", run("text").alias("fp"))
    return found.select("doc_id", "fp.hi", "fp.lo").where("hi is not null")


def changes(segments: int) -> list[int]:
    """Masks over the bits of ``segments`` consecutive ones that a chain may differ in, the first of which has agreed before.

    Of the first l of these, at most l bits together: what the budgets of the chains of 2 and more leave."""
    out = [0]
    for k in range(1, segments + 1):
        out = [m << WIDTH | x for m in out for x in range(1 << WIDTH) if m.bit_count() + x.bit_count() <= k]
    return out


def budget(chain: int) -> int:
    return chain * TAU // BOXES


def turned(hi: np.ndarray, lo: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits, turned so that a segment is the first."""
    if start >= HALF:
        hi, lo, start = lo, hi, start - HALF
    if not start:
        return hi, lo
    left, right = np.uint64(WIDTH * start), np.uint64(64 - WIDTH * start)
    return hi << left | lo >> right, lo << left | hi >> right


def chained(a: np.ndarray) -> np.ndarray:
    """Which differences (the upper half of the bits, turned) keep the budgets of the chains of 1 to 8 segments."""
    keep = np.arange(len(a))
    for chain in range(1, HALF + 1):
        keep = keep[np.bitwise_count(a[keep] >> np.uint64(64 - WIDTH * chain)) <= budget(chain)]
    return keep


def candidates(keys: np.ndarray, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each pair of keys that differ in one of the masks, once, some at a time."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    for mask in masks:
        wanted = ordered ^ mask
        first = np.searchsorted(ordered, wanted, "left")
        last = np.searchsorted(ordered, wanted, "right")
        # the partner of each pair stands behind it
        first = np.maximum(first, np.arange(1, len(keys) + 1))
        n = np.maximum(last - first, 0)
        ends = np.cumsum(n)
        at = 0
        while at < len(n) and ends[-1]:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            size = n[at:stop]
            total = int(size.sum())
            for low in range(0, total, PAIRS):
                k = np.arange(low, min(low + PAIRS, total))
                left = np.searchsorted(np.cumsum(size), k, "right")
                yield order[at + left], order[first[at + left] + k - (np.cumsum(size) - size)[left]]
            at = stop


def near_in_group(hi: np.ndarray, lo: np.ndarray, start: int, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distance of the pairs within TAU of points that agree in the segment at ``start`` and whose chains there keep their budgets; ``segments`` of those behind it find the candidates."""
    a, b = turned(hi, lo, start)
    keys = (a >> np.uint64(64 - WIDTH * (1 + segments)) & np.uint64((1 << WIDTH * segments) - 1)).astype(np.int64)
    for i, j in candidates(keys, changes(segments)):
        x = a[i] ^ a[j]
        keep = chained(x)
        i, j, x = i[keep], j[keep], x[keep]
        distance = np.bitwise_count(x) + np.bitwise_count(b[i] ^ b[j])
        keep = distance <= TAU
        yield i[keep], j[keep], distance[keep]


def is_first(hi: np.ndarray, lo: np.ndarray, start: int) -> np.ndarray:
    """Of pairs within TAU, by their differing bits, whether no start before this one would have found them."""
    first = np.ones(len(hi), bool)
    for earlier in range(start):
        first[chained(turned(hi, lo, earlier)[0])] = False
    return first


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest place in the component of each of n."""
    out = np.arange(n)
    while len(i):
        low = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, out[i], low)
        np.minimum.at(new, out[j], low)
        new = new[new]
        if (new == out).all():
            return out
        out = new
    return out


def grouped(points: DataFrame) -> DataFrame:
    """start, key, segments, point, hi, lo and changed of the points (point, hi, lo) in every group that they go to.

    ``changed`` counts the bits of the key that aren't the point's own; a pair is found where its lower point has none, or
    none of both."""
    hi, lo = F.col("hi"), F.col("lo")

    def upper(start: int) -> Column:
        high, low = (hi, lo) if start < HALF else (lo, hi)
        by = WIDTH * start % 64
        return high if by == 0 else F.shiftleft(high, by).bitwiseOR(F.shiftrightunsigned(low, 64 - by))

    turns = F.explode(F.array(*(F.struct(F.lit(i).alias("start"), upper(i).alias("a")) for i in range(BOXES))))
    rows = points.select("point", "hi", "lo", turns.alias("t")).select("point", "hi", "lo", "t.*")
    rows = rows.withColumns({"segments": F.lit(1), "key": F.shiftrightunsigned("a", 64 - WIDTH), "changed": F.lit(0)})
    out = []
    for segments in range(1, MOST_SEGMENTS):
        large = cut(rows.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_POINTS).select("start", "key"))
        if large.isEmpty():
            break
        out.append(rows.join(small_side(large), ["start", "key"], "left_anti"))
        # the chain of one segment more may differ in as many bits as there are segments before it
        masks = [m for m in range(1 << WIDTH) if m.bit_count() <= segments]
        mask = F.explode(F.filter(F.array(*map(F.lit, masks)), lambda m: F.bit_count(m) <= segments - F.col("changed")))
        rows = rows.join(small_side(large), ["start", "key"], "left_semi").withColumn("mask", mask)
        own = F.shiftrightunsigned("a", 64 - WIDTH * (segments + 1)).bitwiseAND((1 << WIDTH) - 1)
        key = F.shiftleft(F.col("key"), WIDTH).bitwiseOR(own.bitwiseXOR(F.col("mask")))
        rows = rows.withColumns({"segments": F.lit(segments + 1), "key": key, "changed": F.col("changed") + F.bit_count("mask")}).drop("mask")
    return reduce(DataFrame.unionByName, [*out, rows]).drop("a")


def links(points: DataFrame) -> DataFrame:
    """src, dst and n_links: trees (src < dst) of near points in each group, and on rows of src = dst how many of the links
    of a point count there."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        start, _, segments = (k.as_py() for k in key)
        point, changed = group.column("point").to_numpy(), group.column("changed").to_numpy()
        hi, lo = (group.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        order = np.argsort(point, kind="stable")
        point, hi, lo, own = point[order], hi[order], lo[order], changed[order] == 0
        counts, left, right, size = np.zeros(len(point), np.int64), [], [], 0
        for i, j, _ in near_in_group(hi, lo, start, min(3, segments + (len(point) > DEEP_POINTS))):
            i, j = np.minimum(i, j), np.maximum(i, j)
            keep = own[i] if segments > 1 else slice(None)
            i, j = i[keep], j[keep]
            first = is_first(hi[i] ^ hi[j], lo[i] ^ lo[j], start)
            counts += np.bincount(i[first], minlength=len(point)) + np.bincount(j[first], minlength=len(point))
            left.append(i)
            right.append(j)
            size += len(i)
            if size > 4 * PAIRS:  # keep a tree of what was found so far
                tree = labels(len(point), np.concatenate(left), np.concatenate(right))
                left = [np.flatnonzero(tree != np.arange(len(tree)))]
                right, size = [tree[left[0]]], len(left[0])
        tree = labels(len(point), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(point))
        up, linked = np.flatnonzero(tree != np.arange(len(tree))), np.flatnonzero(counts)
        columns = [np.concatenate([point[tree[up]], point[linked]]), np.concatenate([point[up], point[linked]]), np.concatenate([np.zeros(len(up), np.int64), counts[linked]])]
        return pa.table(columns, ["src", "dst", "n_links"])

    return grouped(points).groupBy("start", "key", "segments").applyInArrow(run, "src bigint, dst bigint, n_links bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the lowest node of its connected component, of every node of an edge (src, dst)."""
    both = cut(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    root = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("root")))
    while True:
        # the lowest root among the neighbours, then the root of that root
        seen = both.join(root.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = root.join(seen, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = root.select(F.col("node").alias("new"), F.col("root").alias("far"))
        step = cut(step.join(jump, "new", "left").select("node", "root", F.least("new", "far").alias("new")))
        if step.where("new <> root").limit(1).count() == 0:
            return root
        root = step.select("node", F.col("new").alias("root"))


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, kept_id, the lowest id of its group, and n_links of each document that isn't the lowest itself.

    n_links counts the other fingerprints within TAU of the document's; of a document with several it is the most."""
    found = cut(fingerprints(documents).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    points = cut(found.groupBy("hi", "lo").agg(F.min("doc_id").alias("point")))
    near = cut(links(points.select(F.xxhash64("hi", "lo").alias("point"), "hi", "lo")))
    # fingerprints are numbered by a hash while they are linked, as documents with several would be one point
    named = points.select(F.xxhash64("hi", "lo").alias("number"), "point")
    tree = near.where("src <> dst")
    edges = tree.join(named.select(F.col("number").alias("src"), F.col("point").alias("a")), "src").join(named.select(F.col("number").alias("dst"), F.col("point").alias("b")), "dst")
    edges = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    # a document whose rows have several fingerprints joins the groups of them all
    members = found.join(points, ["hi", "lo"])
    edges = edges.unionAll(members.where("doc_id <> point").select(F.col("point").alias("src"), F.col("doc_id").alias("dst")))
    counts = near.where("src = dst").groupBy(F.col("src").alias("number")).agg(F.sum("n_links").alias("n"))
    told = found.select("doc_id", F.xxhash64("hi", "lo").alias("number")).join(counts, "number").groupBy("doc_id").agg(F.max("n").alias("n_links"))
    gone = components(edges).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))
    return gone.join(told, "doc_id", "left").select("doc_id", "kept_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents without those of which a near duplicate with a lower id stays, with their columns."""
    gone = groups(documents).select("doc_id")
    return documents.join(small_side(gone), "doc_id", "left_anti").select(documents.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
