"""Models trained on labelled documents: predictions, importance and explanations, each with checks that aren't the fit.

Inputs are shares of kinds of characters of whole texts, the label is the quality. What is checked: at the optimum the
gradient of the loss, taken from the data by one aggregation, is flat; probabilities add up to 1 and the label is the
likeliest; contributions of the inputs and the intercepts add up to the margin between the classes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import models

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHARES = {"letters": r"[A-Za-z]", "digits": r"[0-9]", "capitals": r"[A-Z]", "blanks": r"[ \n\t]", "marks": r"[.,;:!?]", "vowels": r"[aeiou]"}
NAMES = tuple(SHARES)
#: Greatest entry of the gradient that counts as flat; on sf0.01 it is 8e-9 at the fit and 0.2 at coefficients of zero.
FLAT = 1e-3


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label (null without one) and the shares of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    size = F.greatest(F.length("text"), F.lit(1))
    shares = [F.round(F.coalesce(F.regexp_count("text", F.lit(p)) / size, F.lit(0.0)), 6).alias(n) for n, p in SHARES.items()]
    return docs.select("doc_id", *shares).join(labels.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id", "left")


def gradient(rows: DataFrame, names: tuple[str, ...], model) -> np.ndarray:
    """Of the weighted logistic loss with its penalty, by class and input; the sums are one row of an aggregation."""
    labelled = model.transform(models.vectors(rows.filter("label IS NOT NULL"), names)).select("label", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n, k = sum(sizes.values()), model.numClasses
    weight = reduce(lambda out, c: F.when(F.col("label") == c, n / (len(sizes) * sizes[c])).otherwise(out), sizes, F.lit(0.0))
    off = lambda c: weight * (F.get("p", F.lit(c)) - (F.col("label") == c).cast("double"))
    sums = labelled.agg(*[F.sum(off(c) * F.get("x", F.lit(j))) for c in range(k) for j in range(len(names))]).first()
    return np.array(sums, float).reshape(k, -1) / n + model.coefficientMatrix.toArray() / n


def _fitted(spark: SparkSession, sf_dir: str):
    rows = inputs(spark, sf_dir)
    model = models.train(rows, NAMES)
    flat = float(np.abs(gradient(rows, NAMES, model)).max()) < FLAT
    return rows, model, F.lit(flat)


def ml4_ml6_ml7_predictions(spark, sf_dir):
    """Every document's prediction by a model of the labelled ones."""
    rows, model, flat = _fitted(spark, sf_dir)
    given = rows.select("doc_id", F.col("label").alias("given"), *NAMES)
    made = models.predict(given, NAMES, model)
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    best = F.get("probs", F.col("label"))
    return made.select("doc_id", "given", *NAMES, flat.alias("gradient_is_flat"), (F.abs(total - 1) < 1e-9).alias("probabilities_add_up"), ((best == F.array_max("probs")) & (best == F.col("confidence"))).alias("label_is_likeliest"))


def ml9_ml10_importance(spark, sf_dir):
    """Inputs by importance: the mean absolute coefficient, largest first."""
    rows, model, flat = _fitted(spark, sf_dir)
    ranked = models.importance(model, NAMES)
    coefficients = np.abs(model.coefficientMatrix.toArray())
    same = all(abs(v - sum(c[NAMES.index(n)] for c in coefficients) / len(coefficients)) < 1e-9 for n, v in ranked)
    falls = all(a[1] >= b[1] for a, b in zip(ranked, ranked[1:]))
    n = rows.filter("label IS NOT NULL").agg(F.count(F.lit(1)).alias("n_labelled"))
    names = F.explode(F.array(*[F.lit(x) for x, _ in ranked])).alias("input")
    return n.select(names, "n_labelled", flat.alias("gradient_is_flat"), F.lit(same).alias("is_mean_coefficient"), F.lit(falls).alias("falls"))


def ml11_ml12_explanations(spark, sf_dir):
    """What raised and lowered the predicted label of every document, all inputs."""
    rows, model, _ = _fitted(spark, sf_dir)
    made = models.explain(rows.select("doc_id", *NAMES), NAMES, model, len(NAMES))
    intercept, coefficients = model.interceptVector.toArray(), model.coefficientMatrix.toArray()
    margin = lambda c: F.lit(float(intercept[c])) + reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(n) for w, n in zip(coefficients[c], NAMES, strict=True)])
    given = F.aggregate("positive", F.lit(0.0), lambda s, x: s + x["value"]) + F.aggregate("negative", F.lit(0.0), lambda s, x: s + x["value"])
    own = F.when(F.col("label") == 1, margin(1)).otherwise(margin(0))
    other = F.when(F.col("label") == 1, margin(0)).otherwise(margin(1))
    start = F.when(F.col("label") == 1, float(intercept[1])).otherwise(float(intercept[0]))
    ordered = lambda c, sign: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(sign * (F.get(c, i - 1)["value"] - F.get(c, i)["value"]) >= 0, F.lit(True)))
    n_zero = reduce(lambda a, b: a + b, [(F.col(n) == 0).cast("int") for n in NAMES])
    return made.select(
        "doc_id", *NAMES, (F.abs(start + given - own) < 1e-9).alias("contributions_add_up"), (own >= other).alias("label_has_the_margin"),
        (ordered("positive", 1) & ordered("negative", -1)).alias("by_size"), (F.size("positive") + F.size("negative") + n_zero).alias("n_inputs"),
    )


for _f in (ml4_ml6_ml7_predictions, ml9_ml10_importance, ml11_ml12_explanations):
    QUERIES[_f.__name__] = _f

_SHARES = ", ".join(f"round(coalesce(len(regexp_extract_all(text, '{p}')) / CAST(greatest(length(text), 1) AS DOUBLE), 0), 6) AS {n}" for n, p in SHARES.items())
ORACLES["ml4_ml6_ml7_predictions"] = f"SELECT doc_id, CAST(quality AS INTEGER) AS given, {_SHARES}, true AS gradient_is_flat, true AS probabilities_add_up, true AS label_is_likeliest FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)"
ORACLES["ml9_ml10_importance"] = f"SELECT unnest({list(NAMES)}) AS input, count(*) AS n_labelled, true AS gradient_is_flat, true AS is_mean_coefficient, true AS falls FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"
ORACLES["ml11_ml12_explanations"] = f"SELECT doc_id, {_SHARES}, true AS contributions_add_up, true AS label_has_the_margin, true AS by_size, CAST({len(NAMES)} AS INTEGER) AS n_inputs FROM documents"
