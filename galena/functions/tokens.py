"""Counts of tokens by a byte-level BPE vocabulary, or of words where there is none."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import cache_key

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(4)
def encoding(vocabulary: str, pattern: str = PATTERN):
    """The encoding of a file of base64 tokens and their ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None = None, pattern: str = PATTERN) -> Column:
    """How many tokens a text has: 0 for null and empty texts, and for those the encoder fails on.

    ``vocabulary`` is a file that every executor can read. Without it runs of other characters than white space count."""
    if vocabulary is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary, pattern)

        def one(value: str | None) -> int:
            try:
                return len(encode.encode_ordinary(value)) if value else 0
            except Exception:  # noqa: BLE001  an encoder panics on what it can't split: such a text counts as nothing
                return 0

        for batch in batches:
            yield batch.map(one).astype("int64")

    return F.coalesce(F.pandas_udf(run, T.LongType())(text), F.lit(0).cast("bigint"))


def counted(rows: DataFrame, text: str, name: str = "tokens", vocabulary: str | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with the tokens of a text column, and the cache (key, tokens) of all that was counted now.

    Equal texts are counted once, and those in the cache not at all. Keys are encoding, bytes and a hash of the content.
    """
    key = cache_key((vocabulary or "words").rsplit("/", 1)[-1], F.coalesce(F.col(text), F.lit("")))
    keyed = rows.withColumn("_key", key)
    distinct = keyed.groupBy("_key").agg(F.first(text).alias("text"))
    known = cache.select(F.col("key").alias("_key"), F.col("tokens").alias("_known")) if cache is not None else None
    fresh = distinct if known is None else distinct.join(known, "_key", "left_anti")
    made = fresh.select(F.col("_key").alias("key"), token_count(F.col("text"), vocabulary).alias("tokens"))
    every = made if cache is None else made.unionByName(cache.join(distinct.select(F.col("_key").alias("key")), "key", "left_semi").select("key", "tokens"))
    told = keyed.join(every.select(F.col("key").alias("_key"), F.col("tokens").alias(name)), "_key").drop("_key")
    return told, every
