"""Queries on sections lost rows of one key, which their SQL keeps."""

import duckdb
import pytest

from docsift.plans import queries

TEXTS = ["Ravi Shah\nEDUCATION\nB.Tech Computer Science, CGPA: 8.2\n", "Asha Patel\nSKILLS\nPython, Java\nWORK EXPERIENCE\nSoftware Developer Intern at Acme 2020 - 2021\n", "", None]


@pytest.mark.parametrize("name", ["nb15_section_flags", "qs10_qs11_exact_quality"])
def test_rows_of_one_key_are_apart_as_in_the_sql(spark, tmp_path, name):
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[1]), (2, TEXTS[1]), (2, TEXTS[2]), (3, TEXTS[3]), (None, TEXTS[0]), (None, TEXTS[1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (2,), (2,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        for table in ("documents", "customer"):
            db.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = db.execute(queries.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 11
