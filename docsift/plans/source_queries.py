"""Queries over synthetic training rows, and strength and tiers of predictions, which have SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions import rules
from docsift.sources.registry import dataset_rows, synthetic_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def src10_synthetic_rows(spark, sf_dir):
    """As many rows as there are customers: those of each label, and how many have all of a few features within its ranges."""
    rows = synthetic_rows(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").count())
    inside = "has_name = 1 AND skills_count BETWEEN CASE label WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AND CASE label WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 15 END AND resume_word_count BETWEEN CASE WHEN label > 0 THEN 300 ELSE 50 END AND CASE WHEN label > 0 THEN 600 ELSE 200 END"
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(inside), 1)).alias("n_inside"))


def ml3_dataset_rows(spark, sf_dir):
    """Customers as feature rows with the labels of those that have one."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = customer.selectExpr("c_custkey AS id", "c_nationkey AS skills_count", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS grade_score")
    labels = customer.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "CAST(c_custkey % 3 AS INT) AS label")
    return dataset_rows(made, ("skills_count", "grade_score", "projects_count"), labels)


def ml1_ml2_model_inputs(spark, sf_dir):
    """The 18 model inputs of customers in order, absent ones 0, as one joined string and their number."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_nationkey AS skills_count", "c_custkey % 5 AS projects_count")
    rows = dataset_rows(customer, rules.MODEL_INPUTS)
    return rows.select("id", F.array_join(F.array(*[F.col(c).cast("int").cast("string") for c in rules.MODEL_INPUTS]), ",").alias("inputs"), F.lit(len(rules.MODEL_INPUTS)).alias("n"))


def qs17_strength(spark, sf_dir):
    """Strength of predictions, p1 / 2 + p2, its tier by two pairs of thresholds, and low confidence; the probabilities
    are made of the values of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "round(abs(value) - floor(abs(value)), 3) AS p2")
    e = e.selectExpr("event_id", "p2", "round((1 - p2) * 0.5D, 4) AS p1").selectExpr("*", "round(p1 * 0.5D + p2, 6) AS strength", "greatest(p1, p2, round(1 - p1 - p2, 4)) AS confidence")
    tier = lambda high: f"CASE WHEN strength >= {high}D THEN 'Shortlisted' WHEN strength >= 0.45D THEN 'Manual Review' ELSE 'Rejected' END"
    return e.selectExpr("event_id", "strength", f"{tier(0.7)} AS tier", f"{tier(0.65)} AS tier_default", "CASE WHEN confidence < 0.45D THEN 1 ELSE 0 END AS low_confidence")


for _f in (src10_synthetic_rows, ml3_dataset_rows, ml1_ml2_model_inputs, qs17_strength):
    QUERIES[_f.__name__] = _f
ORACLES["src10_synthetic_rows"] = "SELECT CAST(label AS INTEGER) AS label, n, n AS n_inside FROM range(3) t(label), (SELECT CAST(count(*) // 3 AS BIGINT) AS n FROM customer)"
ORACLES["ml3_dataset_rows"] = """
SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS skills_count, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 2) END, 0) AS grade_score, CAST(0 AS DOUBLE) AS projects_count,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS label FROM customer"""
_INPUTS = " || ',' || ".join({"skills_count": "c_nationkey", "projects_count": "(c_custkey % 5)"}.get(c, "'0'") for c in rules.MODEL_INPUTS)
ORACLES["ml1_ml2_model_inputs"] = f"SELECT c_custkey AS id, {_INPUTS} AS inputs, {len(rules.MODEL_INPUTS)} AS n FROM customer"
ORACLES["qs17_strength"] = """
WITH a AS (SELECT event_id, round(abs(value) - floor(abs(value)), 3) AS p2 FROM events), b AS (SELECT *, round((1 - p2) * 0.5, 4) AS p1 FROM a),
c AS (SELECT *, round(p1 * 0.5 + p2, 6) AS strength, greatest(p1, p2, round(1 - p1 - p2, 4)) AS confidence FROM b)
SELECT event_id, strength, CASE WHEN strength >= 0.7 THEN 'Shortlisted' WHEN strength >= 0.45 THEN 'Manual Review' ELSE 'Rejected' END AS tier,
  CASE WHEN strength >= 0.65 THEN 'Shortlisted' WHEN strength >= 0.45 THEN 'Manual Review' ELSE 'Rejected' END AS tier_default, CASE WHEN confidence < 0.45 THEN 1 ELSE 0 END AS low_confidence FROM c"""
