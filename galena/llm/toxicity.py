"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

Features are the frequencies of character n-grams in a text (lower case, other characters than letters and digits as one
space), hashed to buckets and multiplied by the log ratio of their smoothed document counts in toxic and clean labelled
texts. A logistic regression over these is trained on the driver from a bounded sample of the labelled rows
(``max_toxic`` and ``max_clean`` documents of at most ``max_chars`` characters together a class, taken in the order of a
hash of the id); a fifth of it is held out to set the threshold. Scoring covers every document and whole texts in one
map without a shuffle: the model has at most ``max_features`` weights, whatever the size of the corpus.

Ids may be of any type; of rows that share an id one text is learnt from, that with the least hash.

Defined results: a null, empty or letterless text scores minus the size of the threshold and is never toxic; a text that
scores 0 isn't toxic; rows are scored one by one, so repeated rows and null ids stay; without labelled rows of both
classes nothing is toxic and scores are null; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import bounded, fresh, id_hash, small_side, table


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (3, 4, 5, 6, 7)
    bits: int = 22
    max_toxic: int = 1500
    max_clean: int = 2500
    max_chars: int = 8_000_000
    max_features: int = 20_000
    min_docs: int = 4
    prior: int = 300  # added to the number of n-grams of a text, so that a few words decide little
    alpha: float = 1.0
    ridge: float = 30.0
    steps: int = 150


@dataclass(frozen=True)
class Model:
    params: Params
    buckets: np.ndarray  # order index << bits | bucket
    weights: np.ndarray
    threshold: float
    ratios: np.ndarray  # naive Bayes log-count ratios of the buckets, which the weights have in them
    held_out: tuple[int, int, int, int] = (0, 0, 0, 0)  # true and false positives, false and true negatives


def buckets_of(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram buckets of a text (order index << bits | bucket) and their frequencies."""
    codes, _, _ = kernels.padded([text])
    found = [b | np.uint32(k << p.bits) for k, (n, b) in enumerate(kernels.gram_buckets(codes, p.orders, p.bits))]
    if not found:
        return np.empty(0, np.uint32), np.empty(0)
    which, count = np.unique(np.concatenate(found), return_counts=True)
    return which, count / (count.sum() + p.prior)


def fit(texts: list[str], toxic: list[int], p: Params = Params()) -> Model | None:
    """The classifier; None unless both classes occur."""
    y = np.asarray(toxic, bool)
    if y.all() or not y.any():
        return None
    held = np.arange(len(y)) % 5 == 4
    if not (y[held].any() and not y[held].all() and y[~held].any() and not y[~held].all()):
        held[:] = False
    train = ~held
    # two passes over the sample: document counts of all buckets, then the frequencies of the chosen ones
    counts = np.zeros((2, len(p.orders) << p.bits), np.uint16)
    for text, toxic_, used in zip(texts, y, train, strict=True):
        if used:
            counts[int(toxic_), buckets_of(text, p)[0]] += 1
    seen = np.flatnonzero(counts.any(0))
    neg, pos = counts[:, seen] + p.alpha
    del counts
    ratio = np.log(pos / (y[train].sum() + 2 * p.alpha)) - np.log(neg / ((~y[train]).sum() + 2 * p.alpha))
    # the features whose ratio is least likely to be chance: ratio times the root of the document count
    rank = np.where(pos + neg - 2 * p.alpha >= min(p.min_docs, max(1, train.sum() // 20)), np.abs(ratio) * np.sqrt(pos + neg), 0)
    chosen = np.flatnonzero(rank > 0)
    if len(chosen) > p.max_features:
        chosen = np.sort(chosen[np.argsort(-rank[chosen], kind="stable")[: p.max_features]])
    if not len(chosen):
        return None
    kinds, ratio = seen[chosen].astype(np.uint64), ratio[chosen]
    new = np.full(len(p.orders) << p.bits, -1, np.int32)
    new[kinds] = np.arange(len(kinds))
    cols, values, sizes = [], [], []
    for text in texts:
        which, value = buckets_of(text, p)
        c = new[which]
        cols.append(c[c >= 0])
        values.append(value[c >= 0])
        sizes.append(len(cols[-1]))
    del new
    row, col = np.repeat(np.arange(len(texts)), sizes), np.concatenate(cols)
    x = np.concatenate(values) * ratio[col]
    rms = np.sqrt(np.bincount(row, x * x, len(texts))[train].mean())
    x = x / max(rms, 1e-12)
    share = np.where(y, 0.5 / y[train].sum(), 0.5 / (~y[train]).sum()) * train
    w, b = np.zeros(len(chosen)), 0.0
    speed, before = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, p.steps + 1):  # Adam over the whole sample
        z = np.bincount(row, x * w[col], len(texts)) + b
        err = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, x * err[row], len(chosen)) + p.ridge * w / len(chosen), err.sum())
        before = 0.9 * before + 0.1 * grad
        speed = 0.99 * speed + 0.01 * grad * grad
        move = 0.1 * (before / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    z = np.bincount(row, x * w[col], len(texts)) + b
    # the threshold with the most right on the held-out rows, in the middle of the best interval; more false alarms weigh double
    judged = held if held.any() else train
    order = np.argsort(z[judged])
    zs, ys = z[judged][order], y[judged][order]
    cost = np.concatenate([[0], np.cumsum(ys)]) + 2 * np.concatenate([np.cumsum((~ys)[::-1])[::-1], [0]])
    best = np.flatnonzero(cost == cost.min())
    k = int(best[len(best) // 2])
    cutoff = (zs[max(k - 1, 0)] + zs[min(k, len(zs) - 1)]) / 2
    said = z[judged] >= cutoff
    truth = y[judged]
    held_out = tuple(int(v.sum()) for v in (said & truth, said & ~truth, ~said & truth, ~said & ~truth)) if held.any() else (0, 0, 0, 0)
    return Model(p, kinds, w * ratio / max(rms, 1e-12), float(cutoff - b), ratio, held_out)


def sample(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[list[str], list[int]]:
    """The bounded training sample: documents of each class in the order of a hash of the id."""
    marks = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("order", id_hash())
    picked = None
    for kind, most in ((1, p.max_toxic), (0, p.max_clean)):
        some = marks.where(F.col("toxic") == kind).orderBy("order", F.col("doc_id").cast("string")).limit(most)
        picked = some if picked is None else picked.unionAll(some)
    found = documents.select("doc_id", "text").where("text is not null").join(small_side(picked), "doc_id")
    # of rows that share an id the text with the least hash
    found = found.groupBy("doc_id", "toxic", "order").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    texts, toxic, chars = [], [], {0: 0, 1: 0}
    for r in sorted(found.collect(), key=lambda r: (r.order, str(r.doc_id))):
        if chars[r.toxic] + len(r.text) <= p.max_chars:
            chars[r.toxic] += len(r.text)
            texts.append(r.text)
            toxic.append(r.toxic)
    return texts, toxic


def scorer(model: Model):
    """A pandas UDF: by text the classifier's value above its threshold; positive is toxic."""
    p, buckets, weights, threshold = model.params, model.buckets, model.weights.astype(np.float32), model.threshold

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = []
        for k in range(len(p.orders)):
            mine = (buckets >> np.uint64(p.bits)) == k
            t = np.zeros(1 << p.bits, np.float32)
            t[buckets[mine] & np.uint64((1 << p.bits) - 1)] = weights[mine]
            tables.append(t)
        for batch in batches:
            texts = batch.fillna("").tolist()
            out = np.empty(len(texts))
            for i, j in kernels.slices(texts):
                codes, starts, lengths = kernels.padded(texts[i:j])
                total, grams = np.zeros(j - i), np.zeros(j - i)
                for t, (n, b) in zip(tables, kernels.gram_buckets(codes, p.orders, p.bits), strict=False):
                    total += kernels.sums_by_text(t[b], starts, lengths, n)
                    grams += np.maximum(0, lengths - n + 1)
                out[i:j] = total / (grams + p.prior) - threshold
            yield pd.Series(out)

    return F.pandas_udf(run, T.DoubleType())


def with_score(documents: DataFrame, model: Model | None, name: str) -> DataFrame:
    if model is None:
        return documents.withColumn(name, F.lit(None).cast("double"))
    empty = F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]")
    return bounded(documents).withColumn(name, F.when(empty, F.lit(-abs(model.threshold))).otherwise(scorer(model)(F.col("text"))))


def score(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, score (above 0: toxic) and is_toxic of every row of documents."""
    model = fit(*sample(documents, labels, p), p)
    found = with_score(documents.select("doc_id", "text"), model, "score")
    return found.select("doc_id", F.round("score", 6).alias("score"), F.coalesce(F.col("score") > 0, F.lit(False)).alias("is_toxic"))


def keep_clean(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of documents that aren't toxic, with their columns."""
    model = fit(*sample(documents, labels, p), p)
    name = fresh(documents.columns, "toxicity")
    return with_score(documents, model, name).where(F.coalesce(F.col(name) <= 0, F.lit(True))).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
