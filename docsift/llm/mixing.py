"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources, by code point with null last, weigh ``weights`` in turn and share all words. A source's target stops at
``max_epochs`` times its size; what is over is shared again by weight. With sources in order of cap / weight, those
before a point are capped and the rest share what is left, so one pass of running sums finds the level that repeated
resharing would reach. A document is then taken whole target // size times, and the rest of a source's target goes to
its documents in the order of md5(doc_id), whole until the last, of which a fraction is taken.

That order is kept by md5 prefix: running sums of 4096 prefixes a source, then within a prefix, so that a source with a
third of all rows is spread over all tasks. Only one row a source meets in one task.

The order is of md5(seed and doc_id), so that another seed gives another draw.

Defined results: a null text has size 0 and takes 0; a source of size 0 has target 0; rows without doc_id are placed by
their size instead; equal rows are taken one after the other; an empty table gives an empty result; columns besides
doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import persisted

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
PREFIX = 3


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, whole, rest of each source of (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (((rank - 1) % len(weights)) + 1).cast("int"))
    weighed = by_source.select("source", "source_size", weight.cast("long").alias("weight"))
    weighed = weighed.withColumn("ratio", F.col("source_size").cast("double") * float(max_epochs) / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left.cast("double") / share.cast("double"))
    capped = F.col("level") > F.col("ratio")
    final = F.max(F.when(~capped, F.col("level"))).over(every)
    out = levelled.withColumn("target", F.when(capped, cap.cast("double")).otherwise(final * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("whole", whole)
    return out.select("source", "source_size", "target", "whole", (F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = persisted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")))
    goals = targets(sizes, weights, max_epochs)
    spread = sizes.withColumn("bucket", F.substring(_key(seed), 1, PREFIX))
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)))
    goals = goals.withColumnRenamed("source", "goal_source")
    sums = sums.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), "offset", "source_size", "target", "whole", "rest")
    placed = spread.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy(_key(seed), F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.withColumn("ahead", ahead)
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'size ' || CAST(size AS VARCHAR))) AS k
  FROM documents),
weighed AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
levelled AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3.0 / weight AS ratio FROM weighed),
level AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS DOUBLE)
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM levelled WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, CASE WHEN level > ratio THEN CAST(source_size * 3 AS DOUBLE)
         ELSE max(CASE WHEN level <= ratio THEN level END) OVER () * weight END AS target FROM level),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole,
         CAST(floor(s.target + 0.5) AS BIGINT) - s.whole * s.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sizes d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(whole * size + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken
FROM placed
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
