"""Queries of pages of blocks, as a reader that knows where they lie gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.sources.files import page_text, two_columns

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Eight to thirteen blocks a page; of every third document all lie left, of the others they alternate.
_BLOCKS = "transform(sequence(1, 8 + CAST(doc_id % 6 AS INT)), i -> named_struct('x0', CAST(IF(i % 2 = 0 OR doc_id % 3 = 0, 10, 310) AS DOUBLE), 'y0', CAST((i * 7) % 11 AS DOUBLE), 'x1', CAST(IF(i % 2 = 0 OR doc_id % 3 = 0, 290, 590) AS DOUBLE), 'text', concat('block ', i, ' of the shop')))"


def _pages(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id")
    return customer.selectExpr("doc_id", "explode(sequence(1, 1 + CAST(doc_id % 3 AS INT))) AS page", "600.0D AS width", f"{_BLOCKS} AS blocks")


def src4_column_order(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page", F.array_join(two_columns(F.col("blocks"), F.col("width")), "|").alias("texts"))


def src4_page_text(spark, sf_dir):
    """With projects recovered; a name counts once, so that every fifth document says what it developed."""
    pages = _pages(spark, sf_dir).withColumn("blocks", F.expr("transform(blocks, b -> named_struct('x0', b.x0, 'y0', b.y0, 'x1', b.x1, 'text', IF(doc_id % 5 = 0, concat(b.text, ' developed as a web app'), b.text)))"))
    return page_text(pages)


QUERIES |= {"src4_column_order": src4_column_order, "src4_page_text": src4_page_text}
ORACLES["src4_column_order"] = """
WITH d AS (SELECT c_custkey AS doc_id FROM customer), p AS (SELECT doc_id, unnest(range(1, 2 + doc_id % 3)) AS page FROM d),
b AS (SELECT doc_id, page, unnest(range(1, 9 + doc_id % 6)) AS i FROM p),
x AS (SELECT *, CASE WHEN i % 2 = 0 OR doc_id % 3 = 0 THEN 0 ELSE 1 END AS side, (i * 7) % 11 AS y FROM b),
n AS (SELECT *, sum(side) OVER w AS n_right, count(*) OVER w - sum(side) OVER w AS n_left FROM x WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, CAST(page AS INTEGER) AS page, string_agg('block ' || i || ' of the shop', '|' ORDER BY CASE WHEN n_left > 4 AND n_right > 4 THEN side ELSE 0 END, y, side, i) AS texts FROM n GROUP BY doc_id, page"""
