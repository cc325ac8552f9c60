"""Language identification by error-correcting output codes.

Each language has a codeword; binary classifiers on the frequencies of character n-grams predict its bits. Up to
``EXHAUSTIVE`` languages have the exhaustive code of 2^(k-1) - 1 bits, more a code of random words with the largest least
distance of several draws. A text's language is that with the least loss log(1 + exp(-margin * bit)) over the bits, each
weighed by how far its classifier is right on held-out rows beyond chance; the text is ambiguous if the two best languages
are nearer than ``gap``. The classifiers are fitted on the driver to a bounded sample of the labelled rows, the documents
whose language is known: ``per_language`` rows of each in the order of a hash of the id, of at most ``max_chars`` characters
a language. Identification covers every document and whole texts in one map without a shuffle.

Defined results: null texts and texts without a letter or digit have no language and are ambiguous, as are all texts if
fewer than two languages are known; rows are judged one by one, so repeated rows and null ids stay; equal losses go to the
language that comes first in the alphabet and are ambiguous; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, id_hash, small_side, table

EXHAUSTIVE = 6


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 12
    per_language: int = 400
    max_chars: int = 2_000_000
    steps: int = 120
    ridge: float = 1e-4
    gap: float = 0.15


@dataclass(frozen=True)
class Model:
    params: Params
    languages: list[str]
    code: np.ndarray  # by language and bit: -1 or 1
    table: np.ndarray  # by bucket (order index << bits | bucket) and bit
    bias: np.ndarray
    weight: np.ndarray  # of each bit; they sum to 1


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k words of -1 and 1."""
    if k <= EXHAUSTIVE:
        columns = np.arange(1, 1 << (k - 1))
        first = np.zeros(len(columns), np.int64)
        rest = [columns >> i & 1 for i in range(k - 1)]
        return 2 * np.stack([first, *rest]) - 1
    rng, best, far = np.random.default_rng(seed), None, -1
    n = 10 * int(np.ceil(np.log2(k)))
    for _ in range(200):
        code = rng.choice([-1, 1], (k, n))
        if (np.abs(code.sum(0)) == k).any():
            continue
        apart = ((n - code @ code.T) // 2 + n * np.eye(k, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


def frequencies(texts: list[str], p: Params, chosen: np.ndarray) -> np.ndarray:
    place = np.full(len(p.orders) << p.bits, -1)
    place[chosen] = np.arange(len(chosen))
    out = np.zeros((len(texts), len(chosen)), np.float32)
    for r, text in enumerate(texts):
        codes, _, _ = kernels.padded([text])
        found = np.concatenate([b.astype(np.int64) + (k << p.bits) for k, (n, b) in enumerate(kernels.gram_buckets(codes, p.orders, p.bits))] or [np.empty(0, np.int64)])
        at = place[found]
        np.add.at(out[r], at[at >= 0], 1)
        out[r] /= max(1, len(found))
    return out


def fit(texts: list[str], languages: list[str], p: Params = Params()) -> Model | None:
    names = sorted(set(languages))
    if len(names) < 2:
        return None
    y = np.array([names.index(v) for v in languages])
    seen = np.zeros(len(p.orders) << p.bits, np.int64)
    for text in texts:
        codes, _, _ = kernels.padded([text])
        for k, (_, b) in enumerate(kernels.gram_buckets(codes, p.orders, p.bits)):
            seen[np.unique(b).astype(np.int64) + (k << p.bits)] += 1
    chosen = np.flatnonzero(seen)
    x = frequencies(texts, p, chosen)
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-10)
    x *= scale / np.sqrt(len(chosen))
    held = np.arange(len(y)) % 5 == 4
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    w, b = np.zeros((len(chosen), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros((len(chosen) + 1, code.shape[1]), np.float32), np.zeros((len(chosen) + 1, code.shape[1]), np.float32)
    xt, tt = x[~held], target[~held]
    for step in range(1, p.steps + 1):
        err = -tt / (1 + np.exp(np.clip(tt * (xt @ w + b), -30, 30))) / max(1, len(tt))
        grad = np.concatenate([xt.T @ err + p.ridge * w / len(tt), err.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    judged = held if held.any() else ~held
    right = ((x[judged] @ w + b > 0) == (target[judged] > 0)).mean(0)
    weight = np.maximum(right - 0.5, 1e-3)
    full = np.zeros((len(p.orders) << p.bits, code.shape[1]), np.float32)
    full[chosen] = w * (scale / np.sqrt(len(chosen)))[:, None]
    return Model(p, names, code, full, b, weight / weight.sum())


def sample(documents: DataFrame, p: Params = Params()) -> tuple[list[str], list[str]]:
    known = documents.where("doc_id is not null and lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    labelled = known.select("doc_id", "lang").distinct().withColumn("order", id_hash())
    # the first of each language: every task passes on no more than that many
    place = F.row_number().over(W.partitionBy("lang").orderBy("order", F.col("doc_id").cast("string")))
    picked = labelled.withColumn("place", place).where(F.col("place") <= p.per_language).drop("place")
    # of rows that share an id and a language the text with the least hash
    found = known.join(small_side(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang", "order").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    texts: list[str] = []
    langs: list[str] = []
    chars: dict[str, int] = {}
    for r in sorted(found.collect(), key=lambda r: (r.order, str(r.doc_id), r.lang)):
        if chars.setdefault(r.lang, 0) + len(r.text) <= p.max_chars:
            chars[r.lang] += len(r.text)
            texts.append(r.text)
            langs.append(r.lang)
    return texts, langs


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The place of the best language and by how much its loss is less than the second's."""
    loss = (np.logaddexp(0, -margins[:, None, :] * model.code[None]) * model.weight).sum(2)
    best = loss.argmin(1)
    two = np.partition(loss, 1, axis=1)[:, :2]
    return best, two[:, 1] - two[:, 0]


def margins(texts: list[str], model: Model) -> np.ndarray:
    p, out = model.params, np.zeros((len(texts), model.code.shape[1]))
    for i, j in kernels.slices(texts):
        codes, starts, lengths = kernels.padded(texts[i:j])
        total, grams = np.zeros((j - i, out.shape[1])), np.zeros(j - i)
        for k, (n, b) in enumerate(kernels.gram_buckets(codes, p.orders, p.bits)):
            part = model.table[k << p.bits : (k + 1) << p.bits]
            total += kernels.sums_by_text(part[b], starts, lengths, n)
            grams += np.maximum(0, lengths - n + 1)
        out[i:j] = total / np.maximum(1, grams)[:, None] + model.bias
    return out


def identify(documents: DataFrame, p: Params = Params(), model: Model | None = None) -> DataFrame:
    """doc_id, language, gap (of the two least losses) and ambiguous of every row of documents."""
    model = model or fit(*sample(documents, p), p)

    @F.pandas_udf("language string, gap double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, gap = decode(margins(batch.fillna("").tolist(), model), model)
            yield pd.DataFrame({"language": np.array(model.languages, object)[best], "gap": gap})

    if model is None:
        found = documents.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("gap"))
    else:
        worded = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
        told = bounded(documents).select("doc_id", worded.alias("worded"), run("text").alias("told"))
        found = told.select("doc_id", *(F.when(F.col("worded"), F.col(f"told.{c}")).alias(c) for c in ("language", "gap")))
    return found.select("doc_id", "language", F.round("gap", 6).alias("gap"), F.coalesce(F.col("gap") < p.gap, F.lit(True)).alias("ambiguous"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
