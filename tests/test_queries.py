"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from millrace.plans import corpus, holdings, judging, registry, search, sites  # noqa: E402, F401

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return connection


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == want


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
