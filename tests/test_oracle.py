"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from galena.plans import queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, str(SF))
    found = db.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == want


def test_queries_without_sql_run(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, str(SF)).count() >= 0
