"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of ``window`` characters that start ``step`` apart and at the end (an item that is
shorter is one window). A part of an item as long as a window starts at most step // 2 from one, so that any such part, and
so any longer one, is found with up to budget - step // 2 edits of its own (6 of 100 characters); shorter parts of a longer
item need not be. A text
leaks an item if some part of it is within ``rate`` edits a character of one of the item's windows, both in lower case with
every run of other characters than letters and digits as one space. By the q-gram lemma a part within e edits of a window
of w characters shares at least w + 1 - q (e + 1) of its q-grams, on at most e + 1 neighbouring diagonals. So the shared
q-grams of every text are counted in diagonal bands of 2 (e + 1), each overlapping the next by half, one of which holds all
these diagonals; the bands that meet the bound are verified by an alignment restricted to the band. No part within the
budget of a window is missed. Bands are counted over shares of a text that overlap by more than a band, which bounds memory. e is at most w // q - 1, so that the bound is at least one.

Texts are scanned in one map without a shuffle. The windows go to the tasks; of a benchmark whose windows have more than
2 * ``part_chars`` characters together one part goes at a time and the texts are scanned once for each.

Defined results: null and empty texts leak nothing; null items and items of fewer than q characters are no evidence; rows
are judged one by one, so repeated rows and null ids stay; an item that occurs in several rows counts under each of its
ids; other columns are ignored by ``leaks`` and kept by ``keep_unleaked``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import bounded, fresh, table


@dataclass(frozen=True)
class Params:
    q: int = 10
    window: int = 100
    step: int = 5
    rate: float = 0.08
    part_chars: int = 4_000_000


TABLE_BITS = 24
AT_ONCE = 4096
ENTRIES = 1 << 20


@dataclass(frozen=True)
class Windows:
    """The windows of one part of a benchmark."""

    p: Params
    items: np.ndarray  # of each window the place of its item in ids
    texts: list[np.ndarray]
    ids: list

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.texts], np.int64)


def windows(items: list[tuple[object, str]], p: Params = Params()) -> Windows:
    ids, owners, texts = [], [], []
    for item, text in items:
        codes, starts, lengths = kernels.padded([text])
        codes = codes[1:-1] if len(codes) > 1 else codes
        codes = codes[: -1] if len(codes) and codes[-1] == kernels.SPACE else codes
        codes = codes[1:] if len(codes) and codes[0] == kernels.SPACE else codes
        if len(codes) < p.q:
            continue
        last = max(0, len(codes) - p.window)
        for s in sorted({*range(0, last, p.step), last}):
            owners.append(len(ids))
            texts.append(codes[s : s + p.window])
        ids.append(item)
    return Windows(p, np.array(owners, np.int64), texts, ids)


def budget(length: np.ndarray, p: Params) -> np.ndarray:
    return np.minimum((p.rate * length).astype(np.int64), length // p.q - 1)


def aligned(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits between each pattern (n, w) and a part of its text (n, w + band - 1) on the diagonals of the band."""
    n, w = pattern.shape
    band = text.shape[1] - w + 1
    slope = np.arange(band)
    cost = np.zeros((n, band), np.int64)
    for i in range(w):
        step = cost + (pattern[:, i, None] != text[:, i : i + band])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
    return cost.min(1)


class Scanner:
    def __init__(self, found: Windows) -> None:
        p = self.p = found.p
        self.w = found
        self.length = found.lengths
        self.edits = budget(self.length, p)
        self.least = self.length + 1 - p.q * (self.edits + 1)
        grams, owner, place = [], [], []
        for k, text in enumerate(found.texts):
            ((_, b),) = kernels.gram_buckets(text, (p.q,), TABLE_BITS)
            grams.append(b)
            owner.append(np.full(len(b), k))
            place.append(np.arange(len(b)))
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.kinds, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[self.kinds] = True

    def shares(self, at: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of places with about ``ENTRIES`` entries of the windows each; every band lies wholly in one of them."""
        reach = int((self.length + 2 * self.edits + 2).max())
        upto = np.cumsum(self.count[np.searchsorted(self.kinds, b[at])])
        i = 0
        while True:
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + ENTRIES, "right"))
            j = max(j, int(np.searchsorted(at, at[i] + 2 * reach)))
            yield i, min(j, len(at))
            if j >= len(at):
                return
            i = int(np.searchsorted(at, at[j - 1] + 1 - reach))

    def bands(self, at: np.ndarray, doc: np.ndarray, b: np.ndarray, starts: np.ndarray, shift: int, many: int) -> np.ndarray:
        """The bands that meet the bound, as numbers of text, window and band."""
        kind = np.searchsorted(self.kinds, b[at])
        times = self.count[kind]
        entry = np.repeat(self.first[kind] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        at, doc, win = np.repeat(at, times), np.repeat(doc, times), self.owner[entry]
        band = (at - starts[doc] - self.place[entry] + shift) // (self.edits[win] + 1)
        key = (doc * len(self.length) + win) * many + band
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        return key[count >= self.least[key // many % len(self.length)]]

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, windows found and least edits, of each pair of a text and an item that it leaks."""
        none = (np.empty(0, np.int64),) * 4
        q = self.p.q
        codes, starts, lengths = kernels.padded(texts)
        if len(codes) < q:
            return none
        ((_, b),) = kernels.gram_buckets(codes, (q,), TABLE_BITS)
        at = np.flatnonzero(self.known[b])
        doc = np.searchsorted(starts, at, "right") - 1
        whole = at + q <= starts[doc] + lengths[doc]
        at, doc = at[whole], doc[whole]
        # a place counts only among as many known q-grams, as close together, as the weakest bound asks for
        least, span = int(self.least.min()), int((self.length + self.edits).max())
        if len(at) < least:
            return none
        dense = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= span)
        marks = np.bincount(dense, minlength=len(at) + 1) - np.bincount(dense + least, minlength=len(at) + 1)[: len(at) + 1]
        near = np.cumsum(marks)[: len(at)] > 0
        at, doc = at[near], doc[near]
        if not len(at):
            return none
        shift = 2 * int(self.length.max())
        many = int(lengths.max()) + shift + 2
        key = np.unique(np.concatenate([self.bands(at[i:j], doc[i:j], b, starts, shift, many) for i, j in self.shares(at, b)]))
        pair, band = key // many, key % many
        doc, win = pair // len(self.length), pair % len(self.length)
        good, cost = np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
        for w in np.unique(self.length[win]):
            mine = np.flatnonzero(self.length[win] == w)
            for some in (mine[i : i + AT_ONCE] for i in range(0, len(mine), AT_ONCE)):
                step = self.edits[win[some]] + 1
                width = w + 2 * int(step[0]) - 1
                place = (band[some] * step - shift)[:, None] + np.arange(width)
                inside = (place >= 0) & (place < lengths[doc[some]][:, None])
                text = np.where(inside, codes[np.where(inside, place + starts[doc[some]][:, None], 0)], 0)
                cost[some] = aligned(np.stack([self.w.texts[k] for k in win[some]]), text)
                good[some] = cost[some] < step
        doc, win, cost = doc[good], win[good], cost[good]
        pairs, back = np.unique(doc * len(self.w.ids) + self.w.items[win], return_inverse=True)
        edits = np.full(len(pairs), 1 << 30)
        np.minimum.at(edits, back, cost)
        hit = np.unique(np.stack([back, win]), axis=1)[0]
        return pairs // max(1, len(self.w.ids)), pairs % max(1, len(self.w.ids)), np.bincount(hit, minlength=len(pairs)), edits


def parts(benchmark: DataFrame, p: Params = Params()) -> list[Windows]:
    out, chars, items = [], 0, []
    held = lambda text: max(len(text), len(text) * p.window // (2 * p.step))
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if items and chars + held(r.text) > p.part_chars:
            out.append(windows(items, p))
            chars, items = 0, []
        items.append((r.item_id, r.text))
        chars += held(r.text)
    out.append(windows(items, p))
    return [w for w in out if len(w.texts)]


def leaks(documents: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, n_windows and min_edits: each row of documents with each item that it leaks."""
    source = bounded(documents).select("doc_id", "text")
    item_kind, doc_kind = benchmark.schema["item_id"].dataType.simpleString(), source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_windows int, min_edits int"

    def over(found: Windows) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(found)
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for i, j in kernels.slices(texts):
                    doc, item, n, edits = scanner.scan(texts[i:j])
                    if len(doc):
                        ids = pa.array([found.ids[k] for k in item])
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + i)), ids, pa.array(n, pa.int32()), pa.array(edits, pa.int32())], ["doc_id", "item_id", "n_windows", "min_edits"])

        return source.mapInArrow(run, schema)

    every = [over(w) for w in parts(benchmark, p)]
    return reduce(DataFrame.unionAll, every) if every else source.sparkSession.createDataFrame([], schema)


def leaking(found: Windows):
    """A pandas UDF: whether a text leaks an item of these windows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(found)
        for batch in batches:
            texts = batch.fillna("").tolist()
            out = np.zeros(len(texts), bool)
            for i, j in kernels.slices(texts):
                out[scanner.scan(texts[i:j])[0] + i] = True
            yield pd.Series(out)

    return F.pandas_udf(run, T.BooleanType())


def keep_unleaked(documents: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of documents that leak no item, with their columns."""
    kept = bounded(documents)
    for found in parts(benchmark, p):
        name = fresh(kept.columns, "leaking")
        kept = kept.withColumn(name, leaking(found)(F.col("text"))).where(~F.col(name)).drop(name)
    return kept


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
