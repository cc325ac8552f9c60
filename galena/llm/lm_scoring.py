"""Cross-entropy difference between matched target and background bigram models.

The target text is that of the documents labelled as good, the background text that of all documents. Both models share
one vocabulary, every word of the background; words are runs of letters in lower case. Each document is scored by models of
all the others: with counts c of model m that leave the document itself out,
P(w|h) = weight c(hw) / c(h) + (1 - weight) (c(w) + 1) / (N + |V|), the unigram alone where h isn't followed by a word
elsewhere. c(h) counts how often h is followed by a word; the shares of all words after h are one. A document's score is
the mean, over its words, of -ln P_target(w|h) + ln P_background(w|h): the lower, the more it is like the target.

All counts are of all documents, and no model has a bound on its size: it grows with the corpus and is never broadcast
or collected. Texts are read once and written as blocks of word codes (``BLOCK_CHARS`` characters, a longer text is a block
of its own). The distinct words and bigrams of a block are sorted by a 64-bit hash, cut into buckets by ranges of it and
shuffled by bucket, each row a block's keys in a bucket with their counts. There the counts of equal keys are added up, and
the totals go back to the blocks by a second shuffle, in the order of the keys. A key is there once a block, however often
it stands in it, so no bucket is much larger than the rest; there are as many buckets as make ``BUCKET_KEYS`` keys each.

Defined results: null texts and texts without letters have no words and null losses and score; rows are scored one by one,
so repeated rows and null ids stay, and a copy of a document counts as another one; labels of a null id count for nothing
and repeated ones as their best; without a target word the target model has add-one shares only; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, scratch, small_side, table

#: What stands before the first word of a text, as a word hash.
START = np.uint64(0x5EED)
BLOCK_CHARS = 16 << 20
BUCKET_KEYS = 1 << 20
COUNTS = ("t", "b", "ht", "hb")


@dataclass(frozen=True)
class Params:
    weight: float = 0.6  # of the bigrams


def blocks(documents: DataFrame, labels: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The written table of word codes: a row a block of documents.

    block, doc_ids, good and sizes (by document: whether it is labelled so, its words), words (hashes, that of the start
    first), t, b, ht and hb (by word: how often it stands in the target and the background, and before a word in them) and
    tokens (32-bit places in ``words``, document after document, in planes of bytes)."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    good = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    source = bounded(documents).select("doc_id", "text").join(small_side(good), F.col("doc_id") == F.col("good_id"), "left")
    source = source.select("doc_id", "text", F.col("good_id").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, sizes, hashes, chars = [], [], [], [], 0
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            for i, j in kernels.slices(texts):
                at, found = kernels.words(texts[i:j], kernels.letter_table)
                ids.append(b.column("doc_id").slice(i, j - i))
                flags.append(b.column("good").slice(i, j - i))
                sizes.append(np.bincount(at, minlength=j - i))
                hashes.append(found)
                chars += sum(map(len, texts[i:j]))
                if chars >= block_chars:
                    yield block(ids, flags, sizes, hashes)
                    ids, flags, sizes, hashes, chars = [], [], [], [], 0
        if ids:
            yield block(ids, flags, sizes, hashes)

    counts = ", ".join(f"{c} array<int>" for c in COUNTS)
    made = source.mapInArrow(run, f"doc_ids array<{kind}>, good array<boolean>, sizes array<int>, words array<bigint>, {counts}, tokens binary")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


def written(df: DataFrame, what: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path := scratch(df.sparkSession, what))
    return df.sparkSession.read.parquet(path)


def block(ids: list, flags: list, sizes: list, hashes: list) -> pa.RecordBatch:
    tokens, words = pd.factorize(np.concatenate([np.array([START]), *hashes]))
    tokens = tokens[1:].astype(np.int32)
    size = np.concatenate(sizes)
    good = pa.concat_arrays(flags)
    mine = np.repeat(good.to_numpy(zero_copy_only=False), size)
    before = histories(tokens, size)
    counts = (np.bincount(x, minlength=len(words)).astype(np.int32) for x in (tokens[mine], tokens, before[mine], before))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    lists = [pa.concat_arrays(ids), good, pa.array(size.astype(np.int32)), pa.array(words.view(np.int64)), *map(pa.array, counts)]
    return pa.RecordBatch.from_arrays([*map(one, lists), pa.array([planes(tokens)], pa.binary())], ["doc_ids", "good", "sizes", "words", *COUNTS, "tokens"])


def unpacked(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block its tokens, the sizes of its documents, and by document whether it is labelled as good."""
    return from_planes(row["tokens"].as_py(), np.int32).astype(np.int64), row["sizes"].values.to_numpy(), row["good"].values.to_numpy(zero_copy_only=False)


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The code before each; 0, the start, before the first of a document."""
    out = np.zeros(len(tokens), np.int64)
    out[1:] = tokens[:-1]
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return out


def occurrences(keys: np.ndarray) -> np.ndarray:
    """Of each key how often it occurs."""
    at, distinct = pd.factorize(keys)
    return np.bincount(at, minlength=len(distinct))[at]


def pairs_of(tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the place of its bigram among the distinct ones, and the keys of these."""
    at, pairs = pd.factorize(histories(tokens, sizes) * len(words) + tokens)
    h, w = words[pairs // len(words)], words[pairs % len(words)]
    return at, kernels.mix64(h * np.uint64(0x9E3779B97F4A7C15) + kernels.mix64(w))


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte from the lowest, which packs better."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def keyed(made: DataFrame, pairs: bool, buckets: int) -> DataFrame:
    """bucket, block, keys (sorted hashes) and counts of the words (t, b, ht and hb) or bigrams (t and b) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                keys = row["words"].values.to_numpy().view(np.uint64)
                if pairs:
                    tokens, sizes, good = unpacked(row)
                    at, keys = pairs_of(tokens, sizes, keys)
                    counts = [np.bincount(x, minlength=len(keys)).astype(np.int32) for x in (at[np.repeat(good, sizes)], at)]
                else:
                    counts = [row[c].values.to_numpy() for c in COUNTS]
                order = np.argsort(keys)
                keys, counts = keys[order], [c[order] for c in counts]
                which = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                starts, ends = np.flatnonzero(np.diff(which, prepend=-1)), np.flatnonzero(np.diff(which, append=-1)) + 1
                for i, j in zip(starts, ends, strict=True):
                    packed = planes(np.concatenate([c[i:j] for c in counts]))
                    yield pa.RecordBatch.from_arrays([pa.array([which[i]]), pa.array([row["block"].as_py()]), pa.array([keys[i:j].tobytes()]), pa.array([packed])], ["bucket", "block", "keys", "counts"])

    columns = ["block", "words", *(("sizes", "good", "tokens") if pairs else COUNTS)]
    return made.select(*columns).mapInArrow(run, "bucket int, block bigint, keys binary, counts binary")


def totals(rows: DataFrame) -> DataFrame:
    """bucket, block and the totals over all blocks of its keys, and on one row of each bucket the number of distinct keys."""

    def run(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in lists])
        at, distinct = pd.factorize(np.concatenate(lists))
        parts = [from_planes(c, np.int32).reshape(-1, len(k)) for c, k in zip(group.column("counts").to_pylist(), lists, strict=True)]
        sums = np.stack([np.bincount(at, c, len(distinct)).astype(np.int64)[at] for c in np.concatenate(parts, 1)])
        out = [planes(sums[:, j - len(k) : j].ravel()) for j, k in zip(ends, lists, strict=True)]
        number = np.zeros(len(lists), np.int64)
        number[0] = len(distinct)
        return pa.table([group.column("bucket"), group.column("block"), pa.array(out), pa.array(number)], ["bucket", "block", "totals", "distinct"])

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, block bigint, totals binary, distinct bigint")


def score(documents: DataFrame, labels: DataFrame, p: Params = Params(), block_chars: int = BLOCK_CHARS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of every row of documents."""
    made = blocks(documents, labels, block_chars)
    kind = documents.schema["doc_id"].dataType.simpleString()
    # the start isn't a word, but stands among those of each block with counts of 0
    add = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)), F.lit(0))
    n = made.agg(add("t").alias("t"), add("b").alias("b"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("keys")).first()
    words = written(totals(keyed(made, False, -(-n["keys"] // bucket_keys) or 1)), "lm-words")
    v = (words.agg(F.sum("distinct")).first()[0] or 1) - 1
    pairs = totals(keyed(made, True, -(-n.b // bucket_keys) or 1))
    found = words.withColumn("pairs", F.lit(False)).unionByName(pairs.withColumn("pairs", F.lit(True)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        tokens, sizes, good = unpacked(row)
        hashes = row["words"].values.to_numpy().view(np.uint64)
        at, keys = pairs_of(tokens, sizes, hashes)
        told = sorted(zip(right.column("pairs").to_pylist(), right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True), key=lambda r: r[:2])

        def by_place(pairs: bool, keys: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
            values = [from_planes(t, np.int64).reshape(len(names), -1) for which, _, t in told if which == pairs]
            out = np.empty((len(names), len(keys)), np.int64)
            out[:, np.argsort(keys)] = np.concatenate([np.empty((len(names), 0), np.int64), *values], 1)
            return dict(zip(names, out, strict=True))

        known, count = by_place(False, hashes, COUNTS), by_place(True, keys, ("t", "b"))
        before = histories(tokens, sizes)
        whose = np.repeat(np.arange(len(sizes)), sizes)
        own_pair, own_before, own_token = (occurrences(whose * k + x) for k, x in ((len(keys), at), (len(hashes), before), (len(hashes), tokens)))
        means = []
        for m, size in (("t", n.t), ("b", n.b)):
            # the document's own share of the counts: nothing of the target if it isn't part of it
            part = np.repeat(good, sizes).astype(np.int64) if m == "t" else np.ones(len(tokens), np.int64)
            followed = known[f"h{m}"][before] - part * own_before
            weight = np.where(followed > 0, p.weight, 0.0)
            unigram = (known[m][tokens] - part * own_token + 1) / (size - part * sizes[whose] + v)
            share = weight * (count[m][at] - part * own_pair) / np.maximum(followed, 1) + (1 - weight) * unigram
            with np.errstate(invalid="ignore"):
                means.append(pa.array(np.bincount(whose, -np.log(share), len(sizes)) / sizes, mask=sizes == 0))
        return pa.table([row["doc_ids"].values, pa.array(sizes.astype(np.int64)), *means], ["doc_id", "n_tokens", "t", "b"])

    told = made.select("block", "doc_ids", "good", "sizes", "words", "tokens")
    out = told.groupBy("block").cogroup(found.select("block", "pairs", "bucket", "totals").groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens bigint, t double, b double")
    return out.select("doc_id", "n_tokens", F.round("t", 6).alias("loss_target"), F.round("b", 6).alias("loss_background"), F.round(F.col("t") - F.col("b"), 6).alias("score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
texts AS (
  SELECT row_number() OVER () AS row, d.doc_id, (g.doc_id IS NOT NULL)::BIGINT AS good,
    coalesce(regexp_extract_all(lower(text), '\p{L}+'), []) AS words
  FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id),
said AS (
  SELECT row, good, unnest(words) AS w, unnest(list_concat(['<s>'], words[1:len(words) - 1])) AS h FROM texts WHERE len(words) > 0),
uni AS (SELECT w, sum(good) AS t, count(*) AS b FROM said GROUP BY w),
n AS (SELECT coalesce(sum(t), 0) AS t, coalesce(sum(b), 0) AS b, count(*) AS v FROM uni),
hist AS (SELECT h, sum(good) AS t, count(*) AS b FROM said GROUP BY h),
pairs AS (SELECT h, w, sum(good) AS t, count(*) AS b FROM said GROUP BY h, w),
-- each occurrence with how often its pair, history and word stand in its own document
own AS (
  SELECT row, good, h, w, count(*) OVER (PARTITION BY row, h, w) AS p, count(*) OVER (PARTITION BY row, h) AS f,
    count(*) OVER (PARTITION BY row, w) AS u, count(*) OVER (PARTITION BY row) AS d FROM said),
elsewhere AS (
  SELECT own.row, pairs.t - good * p AS tp, hist.t - good * f AS tf, uni.t - good * u + 1 AS tu, n.t - good * d + v AS td,
    pairs.b - p AS bp, hist.b - f AS bf, uni.b - u + 1 AS bu, n.b - d + v AS bd
  FROM own CROSS JOIN n JOIN uni ON own.w = uni.w JOIN hist ON own.h = hist.h JOIN pairs ON own.h = pairs.h AND own.w = pairs.w),
losses AS (
  SELECT row, -ln(CASE WHEN tf > 0 THEN 0.6 * (tp::DOUBLE / tf) + 0.4 * (tu::DOUBLE / td) ELSE tu::DOUBLE / td END) AS lt,
    -ln(CASE WHEN bf > 0 THEN 0.6 * (bp::DOUBLE / bf) + 0.4 * (bu::DOUBLE / bd) ELSE bu::DOUBLE / bd END) AS lb FROM elsewhere)
SELECT doc_id, count(lt) AS n_tokens, round(avg(lt), 6) AS loss_target, round(avg(lb), 6) AS loss_background,
  round(avg(lt) - avg(lb), 6) AS score
FROM texts LEFT JOIN losses ON texts.row = losses.row GROUP BY texts.row, doc_id
"""
