"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are folded to a message by an
aggregation over the array, and the messages are joined: ``<|role|>``, a line break, the texts of the message with an empty
line between, ``<|end|>`` and a line break.

Defined results: turns sort by number (nulls last), then role and text, so ties have one order; repeated turns stay; a null
role is ``unknown`` and a null text is empty; ``<|`` in a role or text becomes ``< |``, so no text can pose as a marker; the
a row of a null conversation is a conversation of its own, as nothing says which rows belong together; other columns are
ignored. A conversation is one row of the result and so in one task, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _plain(c: str, otherwise: str) -> Column:
    return F.replace(F.coalesce(F.col(c).cast("string"), F.lit(otherwise)), F.lit("<|"), F.lit("< |"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_messages and chat of every conversation."""
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), _plain("role", "unknown").alias("role"), _plain("text", "").alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    sorted_turns = conversations.select("conv_id", alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # runs of one role as their first turn and number of turns: texts aren't copied while they are folded
    empty = F.array().cast("array<struct<role:string,first:int,n:int>>")

    def fold(runs: Column, turn: Column) -> Column:
        done, last = F.size(runs), F.element_at(runs, -1)
        more = F.struct(last["role"].alias("role"), last["first"].alias("first"), (last["n"] + 1).alias("n"))
        new = F.struct(turn["role"].alias("role"), F.when(done == 0, F.lit(1)).otherwise(last["first"] + last["n"]).alias("first"), F.lit(1).alias("n"))
        same = (done > 0) & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(runs, 1, done - 1), F.array(more))).otherwise(F.concat(runs, F.array(new)))

    runs = sorted_turns.withColumn("runs", F.aggregate(F.col("turns"), empty, fold))
    texts = F.col("turns.text")
    message = lambda r: F.concat(F.lit("<|"), r["role"], F.lit("|>\n"), F.array_join(F.slice(texts, r["first"], r["n"]), "\n\n"), F.lit("<|end|>\n"))
    return runs.select("conv_id", F.size("turns").alias("n_turns"), F.size("runs").alias("n_messages"), F.array_join(F.transform("runs", message), "").alias("chat"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH plain AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, role, text) AS k FROM plain),
marked AS (SELECT *, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id, alone ORDER BY k))::INT AS fresh FROM placed),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, alone ORDER BY k) AS run FROM marked),
messages AS (
  SELECT conv_id, alone, run, count(*) AS n, '<|' || min(role) || E'|>\n' || string_agg(text, E'\n\n' ORDER BY k) || E'<|end|>\n' AS m
  FROM runs GROUP BY conv_id, alone, run)
SELECT conv_id, sum(n)::INT AS n_turns, count(*)::INT AS n_messages, string_agg(m, '' ORDER BY run) AS chat
FROM messages GROUP BY conv_id, alone
"""
