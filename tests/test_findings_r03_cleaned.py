"""Queries on cleaned texts, where closing single letters makes a header within a word."""

import duckdb
import pytest

from docsift.plans import queries

TEXTS = ["Ravi Shah\nA T I\nEDUCA T ION\nB.Tech Computer Science, CGPA: 8.2\nGujarat University\n", "Ravi Shah\nR I E\nWORK EXPER I ENCE\nSoftware Developer Intern at Acme 2020 - 2021\nDeveloped a booking system for clients\n"]


@pytest.mark.parametrize("name", ["nb15_section_flags", "qs10_qs11_exact_quality"])
def test_headers_of_closed_letters_as_in_the_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (2,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        for table in ("documents", "customer"):
            db.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = db.execute(queries.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
