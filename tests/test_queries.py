"""Each query against its SQL in DuckDB at the smallest scale, and the contract of the entry module."""

from __future__ import annotations

import os

import duckdb
import pytest

from conftest import SF
from gridscribe import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None or v != v else repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
