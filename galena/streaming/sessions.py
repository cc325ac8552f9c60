"""Bursts of changes: what happens until a file tree has been quiet for a while is one re-index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_sessions(changes: DataFrame, gap: str = "300 milliseconds", *keys: str, watermark: str | None = None) -> DataFrame:
    """Keys, first, last, n and the sorted distinct paths of each burst of changes (ts, path, keys).

    A gap as long as the limit still joins. In a stream give a watermark, which bounds the state, and at least one key.
    """
    if watermark:
        changes = changes.withWatermark("ts", watermark)
    burst = changes.groupBy(*keys, F.session_window("ts", gap))
    return burst.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_set("path")).alias("paths")).drop("session_window")
