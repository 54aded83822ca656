"""Word lists by name, configuration files and synthetic training rows.

Word lists are small and bounded (see files.load_wordlist); the registry keeps those already read on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.sources.files import load_wordlist

# Short names of the lists and their files
LISTS = {
    "headers": "common_headers.txt", "locations": "locations.txt", "section_keywords": "section_keywords.txt", "skills": "skills.txt", "programming_languages": "programming_languages.txt", "frameworks": "frameworks.txt",
    "databases": "databases.txt", "tools": "tools.txt", "tech_terms": "tech_terms.txt", "common_languages": "common_languages.txt", "resume_terms": "resume_terms.txt",
}


class MissingList(FileNotFoundError):
    """A required word list isn't there."""


@dataclass
class WordLists:
    """Lists of a folder. A missing list is empty unless required."""

    spark: SparkSession
    folder: str
    held: dict[str, frozenset[str]] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def load(self, name: str, required: bool = False) -> frozenset[str]:
        """By short name or file name."""
        file = LISTS.get(name, name)
        if file in self.held:
            self.hits += 1
            return self.held[file]
        self.misses += 1
        path = str(PurePosixPath(self.folder) / file) if "://" not in self.folder else f"{self.folder.rstrip('/')}/{file}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            if required:
                raise MissingList(path)
            return frozenset()
        self.held[file] = frozenset(load_wordlist(self.spark, path))
        return self.held[file]

    def preload(self, names=tuple(LISTS)) -> dict[str, frozenset[str]]:
        return {n: self.load(n) for n in names}

    def is_loaded(self, name: str) -> bool:
        return LISTS.get(name, name) in self.held

    def stats(self) -> dict[str, int]:
        return {"lists": len(self.held), "words": sum(map(len, self.held.values())), "hits": self.hits, "misses": self.misses}

    def clear(self) -> None:
        self.held.clear()


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML file, read by Spark so that any store will do."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("YAML files need PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(text[0]) if text else {}


def config_value(config: dict, path: str, default=None):
    """The value at a dotted path."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


# By label 0, 1, 2 the range that a feature is drawn from; one value for both ends where it is certain
_REAL = {
    "contact_completeness_score": ((0.1, 0.6), (0.5, 1.0), (0.5, 1.0)), "cgpa_value": ((5.0, 7.0), (6.5, 8.5), (8.0, 10.0)),
    "experience_years_estimate": ((0.0, 1.0), (0.5, 2.5), (2.0, 5.0)), "candidate_readiness_score": ((10.0, 64.0), (65.0, 84.0), (85.0, 100.0)),
}
_WHOLE = {
    "has_name": ((1, 1), (1, 1), (1, 1)), "has_email": ((0, 1), (1, 1), (1, 1)), "has_phone": ((0, 1), (1, 1), (1, 1)), "has_location": ((0, 1), (0, 1), (0, 1)),
    "has_bachelor_degree": ((0, 1), (1, 1), (1, 1)), "is_cs_it_candidate": (None, (0, 1), (1, 1)), "has_top_institution": (None, None, (0, 1)),
    "skills_count": ((1, 5), (4, 9), (8, 15)), "skill_category_count": ((0, 2), (2, 4), (3, 6)), "has_ai_ml_skills": (None, None, (1, 1)), "is_fresher": ((1, 1), None, None),
    "resume_word_count": ((50, 200), (300, 600), (300, 600)), "ats_penalty_no_skills": ((0, 1), None, None), "ats_penalty_unprofessional_email": ((0, 1), None, None),
}


def _drawn(ranges, seed: int, whole: bool) -> Column:
    """A value of the label's range, whole ones with both ends; 0 where the label has none."""
    u, out = F.rand(seed), F.lit(0.0)
    for label, ends in enumerate(ranges):
        if ends:
            low, high = ends
            value = F.floor(u * (high - low + 1)) + low if whole else u * (high - low) + low
            out = F.when(F.col("label") == label, value.cast("double")).otherwise(out)
    return out.cast("int") if whole else out


def synthetic_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n // 3 rows of each label 0, 1, 2 with features biased to it; the same for the same seed and partitions."""
    rows = spark.range(n // 3 * 3).select("id", (F.col("id") % 3).cast("int").alias("label"))
    columns = [(k, r, False) for k, r in _REAL.items()] + [(k, r, True) for k, r in _WHOLE.items()]
    return rows.select("id", "label", *[_drawn(r, seed + i, whole).alias(k) for i, (k, r, whole) in enumerate(columns)])


def dataset_rows(features: DataFrame, names: tuple[str, ...], labels: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The named features as doubles, 0 where missing or null, with the label of the key where there is one."""
    have = set(features.columns)
    chosen = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names]
    out = features.select(key, *([F.col("label")] if labels is None and "label" in have else []), *chosen)
    return out if labels is None else out.join(labels.select(key, "label"), key, "left")


class DuplicateFeature(ValueError):
    """A name is registered twice."""


class FeatureRegistry:
    """Functions from nothing to a column, by feature name."""

    def __init__(self):
        self._made: dict = {}

    def register(self, name: str):
        if not isinstance(name, str) or not name:
            raise ValueError("a feature needs a name")

        def add(f):
            if name in self._made:
                raise DuplicateFeature(name)
            self._made[name] = f
            return f

        return add

    def names(self) -> tuple[str, ...]:
        return tuple(self._made)

    def size(self) -> int:
        return len(self._made)

    def clear(self) -> None:
        self._made.clear()

    def compute(self, rows: DataFrame) -> DataFrame:
        """Adds every registered feature, null as 0."""
        return rows.withColumns({name: F.coalesce(f(), F.lit(0)) for name, f in self._made.items()})
