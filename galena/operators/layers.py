"""Choosing a layer of fidelity for every file within a token budget."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import LAYERS
from ..session import before_ranges, cut, in_ranges

COSTS = ("cost_full", "cost_skeleton", "cost_outline")


def importance(rank: Column, n_symbols: Column) -> Column:
    """By the largest rank in a file; without ranks by its symbols."""
    return F.when(rank > 0, 1000 + 10000 * rank).otherwise(F.when(n_symbols > 0, 1000).otherwise(0) + n_symbols)


def _first_layer(strategy: str) -> int:
    return 0 if strategy == "auto" else LAYERS.index(strategy)


def _with_pins(candidates: DataFrame) -> DataFrame:
    return candidates if "pinned" in candidates.columns else candidates.withColumn("pinned", F.lit(False))


def _cost(layer: Column) -> Column:
    return F.coalesce(*(F.when(layer == k, F.col(c)) for k, c in enumerate(COSTS)), F.lit(0)).cast("bigint")


def downgraded(candidates: DataFrame, budget: int, strategy: str = "auto") -> DataFrame:
    """The first stage as a plan: path, layer (0 full to 3 omitted) and cost after downgrading, least important first.

    Candidates are path, cost_full, cost_skeleton, cost_outline, importance and perhaps pinned. All files begin at the layer
    of the strategy, pinned ones stay at full. A file's steps stand in the order of importance, of equally important ones
    that of the file that costs most now. The steps up to the first total within the budget are taken. Totals by ranges of
    the steps give each range what the ones before it saved, so no task sees all files.
    """
    first = _first_layer(strategy)
    c = _with_pins(candidates).withColumn("start", F.when(F.col("pinned"), 0).otherwise(first))
    total = c.agg(F.coalesce(F.sum(_cost(F.col("start"))), F.lit(0))).first()[0]
    over = int(total) - budget
    costs = [F.col(k).cast("bigint") for k in COSTS] + [F.lit(0).cast("bigint")]
    # a file is gone on with while it costs most: a step that doesn't lower the cost is followed by the next at once
    steps = [F.struct(F.lit(k + 1).alias("step"), F.least(*costs[first : k + 1], costs[k]).alias("now"), (costs[k] - costs[k + 1]).alias("saved")) for k in range(first, 3)]
    each = c.where(~F.col("pinned")).select("path", "importance", F.explode(F.array(*steps)).alias("s")).select("path", "importance", "s.*")
    order = [F.col("importance"), F.col("now").desc(), F.col("path"), F.col("step")]
    ranged = in_ranges(each, *order)
    run = F.sum("saved").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    told = ranged.withColumn("inside", run).join(before_ranges(ranged, F.col("saved")), "part").withColumn("upto", F.col("before") + F.col("inside"))
    key = F.struct("importance", (-F.col("now")).alias("minus"), "path", "step")
    told = cut(told.select("path", "step", "upto", key.alias("key")))
    # the last step is the first after which the total is within the budget; before it the total is above
    if over <= 0:
        taken = told.where(F.lit(False))
    else:
        last = told.where(F.col("upto") >= over).agg(F.min("key").alias("last"))
        taken = told.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("key") <= F.col("last")))
    down = taken.groupBy("path").agg(F.max("step").alias("to"))
    out = c.join(down, "path", "left").withColumn("layer", F.when(F.col("pinned"), 0).otherwise(F.coalesce("to", F.lit(first))))
    return out.select("path", "layer", _cost(F.col("layer")).alias("cost"))


def backfilled(candidates: DataFrame, budget: int, strategy: str = "auto") -> DataFrame:
    """Both stages: path, layer and cost, as ``select_layers``, of files whose paths differ.

    What the first stage leaves of the budget is less than one file costs, and only shrinks. So only files that a raise
    within it exists for are gone through, most important first, until nothing is left; each raise takes a token at least,
    which bounds what the driver keeps."""
    first = cut(downgraded(candidates, budget, strategy))
    left = budget - int(first.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    ceiling = _first_layer(strategy)
    deltas = F.array(*(F.when(F.lit(k) < F.col("layer"), F.col(COSTS[k]) - F.col("cost")) for k in range(ceiling, 3)))
    raised: list[tuple[str, int, int]] = []
    if left > 0:
        open_ = first.join(_with_pins(candidates), "path").where(~F.col("pinned")).withColumn("deltas", deltas).where(F.exists("deltas", lambda d: (d > 0) & (d <= left)))
        for r in open_.orderBy(F.col("importance").desc(), "cost", "path").select("path", "cost", "deltas").toLocalIterator():
            for k, d in enumerate(r.deltas):
                if d is not None and 0 < d <= left:
                    raised.append((r.path, k + ceiling, r.cost + d))
                    left -= d
                    break
            if left == 0:
                break
    new = first.sparkSession.createDataFrame(raised, "path string, new_layer int, new_cost bigint")
    return first.join(new, "path", "left").select("path", F.coalesce("new_layer", "layer").alias("layer"), F.coalesce("new_cost", "cost").alias("cost"))


def select_layers(candidates: Iterable[tuple[str, int, int, int, float, bool]], budget: int, strategy: str = "auto") -> tuple[dict[str, str], int, bool]:
    """Both stages over the files of one pack that are on the driver: layer by path, total and whether it is within the budget.

    Candidates are path, costs of full, skeleton and outline, importance and whether it is pinned. All begin at the
    layer of the strategy (``auto``: full; pinned ones always full). While the total is above the budget the least
    important file goes down a layer, of equals the one that costs most; then, most important first, of equals the
    cheapest first, each goes up to the richest layer, not above its first, that costs more and still fits.
    """
    files = list(candidates)
    first = _first_layer(strategy)
    costs = [(f[1], f[2], f[3], 0) for f in files]
    at = [0 if f[5] else first for f in files]
    total = sum(c[k] for c, k in zip(costs, at, strict=True))
    heap = [(f[4], -costs[i][at[i]], i) for i, f in enumerate(files) if not f[5]]
    heapq.heapify(heap)
    while total > budget and heap:
        rank, _, i = heapq.heappop(heap)
        if at[i] == 3:
            continue
        total += costs[i][at[i] + 1] - costs[i][at[i]]
        at[i] += 1
        heapq.heappush(heap, (rank, -costs[i][at[i]], i))
    for i in sorted((i for i, f in enumerate(files) if not f[5]), key=lambda i: (-files[i][4], costs[i][at[i]], i)):
        for k in range(first, at[i]):
            more = costs[i][k] - costs[i][at[i]]
            if 0 < more <= budget - total:
                total += more
                at[i] = k
                break
    return {f[0]: LAYERS[k] for f, k in zip(files, at, strict=True)}, total, total <= budget
