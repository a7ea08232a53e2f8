"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from rulewake import plans

SQL = plans.oracle_sql()


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
        return float(v)
    return str(v)


def rows(df):
    return sorted(map(repr, (tuple(map(cell, r)) for r in df.reindex(sorted(df.columns), axis=1).itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    got, expected = plans.queries()[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_other_queries_run(spark, small, name):
    df = plans.queries()[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "a1_obligation_table"} <= set(entry.queries())


def test_without_the_optional_package(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "rulewake.llm", None)
    assert entry._extra("QUERIES") == {}
