"""Every registered query of the core on tables without rows, and on tables of nulls."""

import os

import pytest

from rulewake import plans


@pytest.fixture(scope="module", params=["empty", "nulls"])
def edge(request, small, tmp_path_factory):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    folder = tmp_path_factory.mktemp(request.param)
    for name in os.listdir(small):
        t = pq.read_table(f"{small}/{name}").slice(0, 3)
        rows = 0 if request.param == "empty" else t.num_rows
        pq.write_table(pa.table({f.name: pa.nulls(rows, f.type) for f in t.schema}), folder / name)
    return str(folder)


def test_no_query_breaks(spark, edge):
    broken = {}
    for name, query in plans.queries().items():
        try:
            query(spark, edge).count()
        except Exception as e:
            broken[name] = str(e)[:200]
    assert not broken
