"""Training, prediction and explanation over feature columns with Spark ML."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_NAMES = ("Weak", "Average", "Strong")


class OneClass(ValueError):
    """Training needs two classes or more."""


def _logistic(n: int):
    return LogisticRegression(family="multinomial", maxIter=1000, standardization=False, elasticNetParam=0.0, regParam=1.0 / n, weightCol="weight")


def _forest(n: int):
    return RandomForestClassifier(numTrees=300, maxDepth=12, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=42, weightCol="weight")


def _unavailable(n: int):
    raise NotImplementedError("xgboost is not available")


MODELS = {"logistic_regression": _logistic, "random_forest": _forest, "xgboost": _unavailable}


def vectors(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds the vector of the named columns; missing or null ones are 0."""
    filled = rows.withColumns({f"_f_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in names})
    return VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol="features").transform(filled).drop(*[f"_f_{n}" for n in names])


def train(rows: DataFrame, names: tuple[str, ...], model: str = "logistic_regression") -> Model:
    """Fits a model with balanced class weights, n / (k * size of the class); rows with a null label are left out."""
    labelled = vectors(rows.filter("label IS NOT NULL"), names).select("features", F.col("label").cast("double").alias("label"))
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().limit(1000).collect()}
    if len(sizes) < 2:
        raise OneClass(f"{len(sizes)} classes")
    n = sum(sizes.values())
    weights = F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, n / (len(sizes) * c))])
    return MODELS[model](n).fit(labelled.withColumn("weight", weights[F.col("label")]))


def predict(rows: DataFrame, names: tuple[str, ...], model: Model, high: float = 0.70, low: float = 0.45) -> DataFrame:
    """Adds label, label_name, confidence, probs, readiness (55 p1 + 100 p2), strength (p1 / 2 + p2), decision, low_confidence."""
    out = model.transform(vectors(rows.drop("label"), names)).withColumn("probs", vector_to_array("probability"))
    p = lambda i: F.coalesce(F.get("probs", F.lit(i)), F.lit(0.0))
    out = out.withColumns({"label": F.col("prediction").cast("int"), "confidence": F.array_max("probs"), "readiness": F.round(p(1) * 55 + p(2) * 100, 2), "strength": p(1) * 0.5 + p(2)})
    decision = F.when(F.col("strength") >= high, "Shortlisted").when(F.col("strength") >= low, "Manual Review").otherwise("Rejected")
    return out.withColumns({"label_name": F.get(F.array(*map(F.lit, LABEL_NAMES)), "label"), "decision": decision, "low_confidence": F.col("confidence") < low}).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: Model, names: tuple[str, ...], top: int = 10) -> list[tuple[str, float]]:
    """Mean absolute coefficient, or the forest's importance, largest first."""
    values = abs(model.coefficientMatrix.toArray()).mean(axis=0) if hasattr(model, "coefficientMatrix") else model.featureImportances.toArray()
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))[:top]


def explain(rows: DataFrame, names: tuple[str, ...], model: Model, top: int = 5) -> DataFrame:
    """Adds positive and negative: the top contributions, coefficient of the predicted label times value, by size."""
    coefs = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in model.coefficientMatrix.toArray()])
    out = model.transform(vectors(rows.drop("label"), names)).withColumn("x", vector_to_array("features"))
    parts = F.zip_with(F.get(coefs, F.col("prediction").cast("int")), "x", lambda c, x: c * x)
    named = F.zip_with(F.array(*map(F.lit, names)), parts, lambda n, v: F.struct(v.alias("value"), n.alias("name")))
    out = out.withColumn("parts", named)
    up = F.slice(F.sort_array(F.filter("parts", lambda s: s["value"] > 0), asc=False), 1, top)
    down = F.slice(F.array_sort(F.filter("parts", lambda s: s["value"] < 0)), 1, top)
    return out.withColumns({"label": F.col("prediction").cast("int"), "positive": up, "negative": down}).drop("features", "x", "parts", "rawPrediction", "probability", "prediction")
