"""Every query with check SQL against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from granary.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{medium}/{t}.parquet'")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def rows(columns: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, medium, duck):
    df = QUERIES[name](spark, medium)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
    assert want, "the check compares nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() >= 0
