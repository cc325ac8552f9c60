"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, bounded, cut, shared_dir, small_side

__all__ = ["BATCH_BYTES", "bounded", "cut", "fresh", "id_hash", "scratch", "shared_dir", "small_side", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/galena-{what}-{uuid.uuid4().hex}"


def id_hash(column: str = "doc_id") -> Column:
    """The order in which bounded samples are taken: a hash of the id, of any type; rows of one id go by their text."""
    return F.xxhash64(F.col(column).cast("string"))


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
