import duckdb
import pytest

from docsift.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "customer", "part", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(*want.columns).collect())))
    assert rows == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_without_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)
