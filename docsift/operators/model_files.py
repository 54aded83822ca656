"""Models in a folder: Spark's own files, and beside them what the model is and reads, as one JSON line."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import SparkSession

_KINDS = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel)}


@dataclass
class ModelMetadata:
    model_id: str
    name: str
    version: str
    description: str = ""
    kind: str = ""
    framework: str = "spark-ml"
    feature_names: list[str] = field(default_factory=list)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    changelog: list[str] = field(default_factory=list)
    performance_metrics: dict[str, float] = field(default_factory=dict)

    @property
    def features_count(self) -> int:
        return len(self.feature_names)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ModelMetadata:
        return cls(**json.loads(text))


def save_model(spark: SparkSession, model: Model, metadata: ModelMetadata, folder: str) -> None:
    """Overwrites folder/model and folder/metadata."""
    metadata.kind = type(model).__name__
    if metadata.kind not in _KINDS:
        raise ValueError(f"no way to load a {metadata.kind} again")
    model.write().overwrite().save(f"{folder}/model")
    spark.createDataFrame([(metadata.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_model(spark: SparkSession, folder: str) -> tuple[Model, ModelMetadata]:
    metadata = ModelMetadata.from_json(spark.read.text(f"{folder}/metadata").first()[0])
    return _KINDS[metadata.kind].load(f"{folder}/model"), metadata
