"""Synthetic candidates from the driver tables, the same text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SKILLS = ("Python", "Java", "React", "Docker", "AWS", "MySQL", "TensorFlow", "Kafka", "Flutter", "Selenium")


def _pick(i: int) -> str:
    return f"CASE (c_custkey + {i}) % {len(_SKILLS)} " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SKILLS)) + " END"


SQL = f"""
SELECT c_custkey AS doc_id,
  'CANDIDATE ' || CAST(c_custkey AS {{string}}) || chr(10)
  || CASE WHEN c_custkey % 7 <> 0 THEN 'user' || CAST(c_custkey AS {{string}}) || '@example.com' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 5 <> 0 THEN '9' || lpad(CAST(c_custkey AS {{string}}), 9, '0') || chr(10) ELSE '' END
  || 'SKILLS' || chr(10) || {_pick(0)} || chr(10) || {_pick(3)} || chr(10)
  || CASE WHEN c_custkey % 3 <> 0 THEN {_pick(7)} || chr(10) ELSE '' END
  || 'EDUCATION' || chr(10) || 'B.Tech Computer Science CGPA: ' || CAST(5 + c_custkey % 5 AS {{string}}) || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN 'Professional Experience' || chr(10) || 'Software Developer Intern 2019 - 2023' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 4 <> 1 THEN 'PROJECTS' || chr(10) || 'Shop: built a rest api in docker and improved speed by 30%' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 6 = 0 THEN 'Achievements' || chr(10) || 'Winner of a hackathon, passionate team player' || chr(10) ELSE '' END
  || 'https://github.com/user' || CAST(c_custkey AS {{string}}) AS text
FROM {{customer}}
"""
DUCKDB = SQL.format(string="VARCHAR", customer="customer")


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores where a small input would occupy a few; larger inputs have partitions enough and stay."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    return spark.sql(SQL.replace("{string}", "STRING"), customer=customer)
