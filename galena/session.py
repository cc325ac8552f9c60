"""What all parts need of the session: the shared folder and ways to cut lineage and to check a side's size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Rows up to which a counted side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that go to Python at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all executors share.

    Where it is unset, a folder below the warehouse of a local session; on a cluster that is an error, as a folder of one
    machine would be lost with it."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='galena-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_by(df: DataFrame, *columns: str) -> DataFrame:
    """``cut`` of ``df`` in the shuffle's partitions of ``columns`` and sorted by them, so that joins and sums by these shuffle and sort it no more.

    An adaptive plan doesn't tell how its rows lie, so this one is planned without."""
    conf = df.sparkSession.conf
    adaptive, n = conf.get("spark.sql.adaptive.enabled"), int(conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(n, *columns).sortWithinPartitions(*columns))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in Arrow batches of at most ``BATCH_BYTES`` (a longer text is a batch of its own).

    Without it a batch has 10 000 rows however long their texts are, several times over in the memory of the JVM and of the
    Python worker. A lower setting of the session stays."""
    conf = df.sparkSession.conf
    now = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower())
    if now is None or int(now[1]) << 10 * " kmg".index(now[2] or " ") > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to have at most ``rows`` rows and ``BROADCAST_BYTES`` bytes, else unchanged: the join then shuffles."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in df.schema]
    n, size = df.limit(rows + 1).select(sum(sizes, F.lit(0)).cast("bigint").alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted into ranges of ``order``, written once, with the number of the range as ``part``.

    It is written because the ranges and their numbers must be the same for all that is derived from them."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def before_ranges(ranged: DataFrame, amount: Column, name: str = "before") -> DataFrame:
    """part and the sum of ``amount`` over the ranges before it: one row a range, small whatever the number of rows."""
    sums = ranged.groupBy("part").agg(F.sum(amount).cast("bigint").alias("amount"))
    return F.broadcast(sums.select("part", F.coalesce(F.sum("amount").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(name)))


def places(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1: that of the range and that in it, so no task sees all rows."""
    ranged = in_ranges(df, *order)
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    found = ranged.withColumn(name, inside).join(before_ranges(ranged, F.lit(1)), "part")
    return found.withColumn(name, F.col(name) + F.col("before")).drop("part", "before")
