"""Mixing sources to target weights by entropy balancing.

Rates r_i = exp(theta . x_i) minimise the token-weighted relative entropy to the corpus as it is, under constraints on
tokens: each source has its target share of all tokens (exactly); each language keeps a target share and the mean log
length stays what it is (both up to a small ridge, so that the dual has a solution whatever sources and languages occur
together). The dual is convex and is solved by Newton's method. Each step takes one distributed aggregation: of the
documents, summed once to a histogram of (source, language, tokens), the sums a (source, language) of the tilted tokens
and their first two moments in length; only these come to the driver, one row a pair of source and language that occurs,
and at most ``MOST_CELLS`` of them (an error beyond). As the constraints of the sources don't overlap, their best duals follow
from the others: they are put in, and Newton's system has a row a language, however many sources there are. Rates are rounded to copies by a
hash of the document, whose mean is the rate.

Tokens are runs of other characters than white space. Targets are relative weights by source; by default the square root
of the source's tokens, and for languages the power 0.7. The total of tokens stays what it is.

Defined results: a null source or language is a value like any other; a source without target, or with one of 0 or less,
has rate 0, and if no source is left all with tokens have; a target without documents is ignored and the others are scaled
up; the sources have their targets after every step, so that where languages and lengths can't be met as well (say each
source has one document) they stay as near as the numbers allow; null and empty texts have no tokens, rate
1 and one copy; rows are rated one by one, and repeated rows are rounded alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small_side, table

Targets = dict[str | None, float]
SOURCE_POWER = 0.5
LANG_POWER = 0.7
RIDGE = 1e-4
TOLERANCE = 1e-10
STEPS = 60
MOST_CELLS = 2_000_000


@dataclass(frozen=True)
class Solution:
    rates: dict[tuple[str | None, str | None], float]  # by source and language, at mean length
    tilt: float  # of the standardised log length
    mean: float
    spread: float
    steps: int
    error: float  # largest distance of a source's share from its target


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def solve(histogram: DataFrame, targets: Targets | None = None, langs: Targets | None = None) -> Solution:
    """The balanced rates of a histogram (source, lang, n, docs), n > 0."""
    length = F.log1p("n")
    mass = F.col("docs") * F.col("n")
    sizes = histogram.groupBy("source", "lang").agg(F.sum(mass).alias("m"), F.sum(mass * length).alias("a"), F.sum(mass * length * length).alias("b"))
    base = sizes.limit(MOST_CELLS + 1).collect()
    if len(base) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of source and language")
    total = float(sum(r.m for r in base))
    if not total:
        return Solution({}, 0.0, 0.0, 1.0, 0, 0.0)
    mean = sum(r.a for r in base) / total
    spread = math.sqrt(max(0.0, sum(r.b for r in base) / total - mean * mean)) or 1.0

    def shares(values: list, given: Targets | None, power: float) -> dict:
        sums: dict = {}
        for v, r in zip(values, base, strict=True):
            sums[v] = sums.get(v, 0.0) + float(r.m)
        want = {v: max(0.0, float(given.get(v, 0.0))) if given is not None else s**power for v, s in sums.items()}
        whole = sum(want.values())
        return {v: x / whole if whole else 0.0 for v, x in want.items()}

    source_share = shares([r.source for r in base], targets, SOURCE_POWER)
    base = [r for r in base if source_share[r.source] > 0]
    if not base:
        return Solution({}, 0.0, mean, spread, 0, 0.0)
    lang_share = shares([r.lang for r in base], langs, LANG_POWER)
    sources = sorted({r.source for r in base}, key=lambda v: (v is None, v))
    tongues = sorted({r.lang for r in base}, key=lambda v: (v is None, v))
    cells = {(r.source, r.lang): k for k, r in enumerate(base)}
    place = {s: k for k, s in enumerate(sources)}, {t: k for k, t in enumerate(tongues)}
    of_source, of_lang = (np.array([place[k][v] for v in c]) for k, c in enumerate(zip(*cells, strict=True)))
    n_s, n_l = len(sources), len(tongues)
    want_s, want = np.array([source_share[s] for s in sources]), np.array([lang_share[t] for t in tongues] + [0.0])
    z = (length - mean) / spread

    def sums(tilt: float) -> np.ndarray:
        """By cell: tilted share of tokens and its first two moments in z."""
        w = mass * F.exp(F.lit(tilt) * z) / total
        out = np.zeros((len(base), 3))
        for r in histogram.groupBy("source", "lang").agg(F.sum(w).alias("m0"), F.sum(w * z).alias("m1"), F.sum(w * z * z).alias("m2")).collect():
            if (k := cells.get((r.source, r.lang))) is not None:
                out[k] = r.m0, r.m1, r.m2
        return out

    def dual(phi: np.ndarray, moments: np.ndarray) -> tuple[float, np.ndarray]:
        """The dual with the best duals of the sources for these of languages and tilt, and each cell's share of tokens."""
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            level = np.log(moments[:, 0]) + phi[of_lang]
            top = np.full(n_s, -np.inf)
            np.maximum.at(top, of_source, level)
            part = np.exp(level - top[of_source])
            whole = np.bincount(of_source, part, n_s)
            value = want_s @ (top + np.log(whole)) - phi @ want + 0.5 * RIDGE * phi @ phi
            return float(value), want_s[of_source] * part / whole[of_source]

    def newton(share: np.ndarray, moments: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and step: a row a language and one for the tilt, less what sources take up of each direction."""
        at_mean, at_square = moments[:, 1] / moments[:, 0], moments[:, 2] / moments[:, 0]
        grad = np.append(np.bincount(of_lang, share, n_l), share @ at_mean) - want + RIDGE * phi
        hess = np.diag(np.append(np.bincount(of_lang, share, n_l), share @ at_square) + RIDGE)
        hess[-1, :-1] = hess[:-1, -1] = np.bincount(of_lang, share * at_mean, n_l)
        tilt = np.bincount(of_source, share * at_mean, n_s)
        # cells of one source: at most a row a language, and only those that occur
        order = np.argsort(of_source, kind="stable")
        for k in np.split(order, np.flatnonzero(np.diff(of_source[order])) + 1):
            s, at = of_source[k[0]], np.append(of_lang[k], n_l)
            c = np.append(share[k], tilt[s])
            hess[np.ix_(at, at)] -= np.outer(c, c) / want_s[s]
        return grad, np.linalg.lstsq(hess, -grad, rcond=1e-13)[0]

    phi = np.zeros(n_l + 1)
    moments = sums(0.0)
    value, share = dual(phi, moments)
    steps = 0
    for steps in range(1, STEPS + 1):
        grad, move = newton(share, moments, phi)
        if np.abs(grad).max() < TOLERANCE:
            break
        scale, slope = 1.0, float(grad @ move)
        while scale > 1e-9:
            trial = phi + scale * move
            tried = sums(float(trial[-1]))
            after, found = dual(trial, tried)
            if np.isfinite(after) and np.isfinite(found).all() and after <= value + 1e-4 * scale * slope + 1e-14:
                break
            scale /= 2
        else:
            break  # no better in the numbers there are
        phi, value, moments, share = trial, after, tried, found
    error = float(np.abs(np.bincount(of_source, share, n_s) - want_s).max())
    rates = share / moments[:, 0]
    return Solution({c: float(rates[k]) for c, k in cells.items()}, float(phi[-1]), mean, spread, steps, error)


def rated(documents: DataFrame, targets: Targets | None = None, langs: Targets | None = None) -> tuple[DataFrame, list[str]]:
    """documents with three columns more, whose names are returned: tokens, rate and copies."""
    n, rate, copies = (fresh(documents.columns, c) for c in ("n_tokens", "rate", "copies"))
    counted = documents.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokens(F.col("text")).alias("n"))
    found = solve(cut(counted.where("n > 0").groupBy("source", "lang", "n").agg(F.count("*").alias("docs"))), targets, langs)
    spark = documents.sparkSession
    cell = fresh([*documents.columns, n, rate, copies], "cell_rate")
    a, b = fresh(documents.columns, "cell_source"), fresh(documents.columns, "cell_lang")
    # one row a pair of source and language
    cells = spark.createDataFrame([(s, t, r) for (s, t), r in found.rates.items()], f"`{a}` string, `{b}` string, `{cell}` double")
    joined = documents.withColumn(n, tokens(F.col("text"))).join(small_side(cells), F.col("source").cast("string").eqNullSafe(F.col(a)) & F.col("lang").cast("string").eqNullSafe(F.col(b)), "left")
    tilted = F.coalesce(F.col(cell), F.lit(0.0)) * F.exp(F.lit(found.tilt) * (F.log1p(F.col(n)) - found.mean) / found.spread)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    out = joined.withColumn(rate, F.when(F.col(n) > 0, F.round(tilted, 9)).otherwise(1.0))
    out = out.withColumn(copies, (F.floor(F.col(rate)) + (chance < F.col(rate) - F.floor(F.col(rate))).cast("bigint")).cast("bigint"))
    return out.select(*documents.columns, n, rate, copies), [n, rate, copies]


def rates(documents: DataFrame, targets: Targets | None = None, langs: Targets | None = None) -> DataFrame:
    """doc_id, source, lang, n_tokens, rate and copies of every row of documents."""
    return rated(documents.select("doc_id", "text", "source", "lang"), targets, langs)[0].drop("text")


def mixed(documents: DataFrame, targets: Targets | None = None, langs: Targets | None = None) -> DataFrame:
    """Each row of documents as often as its copies say, with the columns of documents, the rate and the number of the copy."""
    found, (n, rate, copies) = rated(documents, targets, langs)
    number = fresh(found.columns, "copy")
    repeated = found.where(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    return repeated.drop(n, copies)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"))
