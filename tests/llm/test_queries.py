"""The registered queries: on the smallest tables, against SQL where there is some, and on tables without rows or of nulls."""

import os

import pytest

from rulewake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    got, expected = queries.QUERIES[name](spark, small).toPandas(), c.execute(queries.SQL[name]).df()
    rows = lambda df: sorted(map(repr, df.reindex(sorted(df.columns), axis=1).astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_no_query_breaks(spark, small, kind, tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    for name in os.listdir(small):
        t = pq.read_table(f"{small}/{name}").slice(0, 3)
        pq.write_table(pa.table({f.name: pa.nulls(0 if kind == "empty" else t.num_rows, f.type) for f in t.schema}), tmp_path / name)
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() >= 0, name


def test_columns_of_the_found_queries(spark, small):
    expected = {
        "p1_found": ["document_id_a", "document_id_b"], "p2_found": ["obligation_id"], "p4_found": ["document_id", "field"], "p5_found": ["first_document_id", "document_id"], "p6_found": ["document_id"],
        "p7_found": ["document_id", "pii_kind"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, columns in expected.items():
        df = queries.QUERIES[name](spark, small)
        assert df.columns == columns and df.count() == df.distinct().count()
