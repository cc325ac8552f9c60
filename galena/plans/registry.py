"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def bm25_sql(words: list[str], limit: int | None) -> str:
    tf = {w: f"(length(lo) - length(replace(lo, '{w}', ''))) / length('{w}')" for w in words}
    idf = lambda k: f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 END)"
    score = " + ".join(f"{idf(k)} * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * l / (s / n)))" for k in range(len(words)))
    return f"""
WITH low AS (SELECT doc_id AS id, lower(text) AS lo, greatest(length(text) - 2, 0) AS l FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, sum(l)::DOUBLE AS s, {", ".join(f"count(*) FILTER (contains(lo, '{w}')) AS n{k}" for k, w in enumerate(words))} FROM low),
tfs AS (SELECT id, l, {", ".join(f"({tf[w]})::DOUBLE AS t{k}" for k, w in enumerate(words))} FROM low WHERE {" AND ".join(f"contains(lo, '{w}')" for w in words)}),
scored AS (SELECT id, {score} AS score FROM tfs, stats)
SELECT id, round(score, 6) AS score{", (row_number() OVER (ORDER BY score DESC, id))::INT AS bm25_rank" if limit else ""} FROM scored{f" ORDER BY scored.score DESC, id LIMIT {limit}" if limit else ""}"""
