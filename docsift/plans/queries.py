"""Queries of the library, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import lexicons as lx
from docsift.functions import text as tx
from docsift.functions.dialect import flag
from docsift.operators.keyword_hits import with_layers_by_hits
from docsift.plans import builder_queries, cleaning_queries, entity_queries, feature_queries, page_queries, model_queries, quality_queries, record_queries, rough, section_queries, source_queries  # noqa: F401 - they register queries
from docsift.operators.sections import ALIASES, section_lines
from docsift.plans.resumes import DUCKDB, resumes, spread

FLAGSHIP = "qs_candidate_readiness"
QUERIES: dict = feature_queries.QUERIES | record_queries.QUERIES | rough.QUERIES | source_queries.QUERIES | page_queries.QUERIES | model_queries.QUERIES
ORACLES: dict[str, str] = feature_queries.ORACLES | record_queries.ORACLES | rough.ORACLES | source_queries.ORACLES | page_queries.ORACLES | model_queries.ORACLES


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the lower-case text of documents and candidates."""
    return _docs(spark, sf_dir).union(resumes(spark, sf_dir).select(F.col("doc_id") + 1000000000, "text")).select("doc_id", F.lower("text").alias("t"))


_count = lambda t, p: f"CAST(len(regexp_extract_all({t}, '{p}')) AS INTEGER)"
_any = lambda t, words: "CASE WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words) + " THEN 1 ELSE 0 END"
_sum = lambda t, words: "CAST(" + " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in words) + " AS INTEGER)"


@_query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM documents")
def tx8_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@_query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def tx11_slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@_query(f"""
SELECT doc_id, substr(text, 1, {tx.MAX_CHARS}) AS text FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= {tx.MIN_WORDS}""")
def tx10_usable_text(spark, sf_dir):
    return _docs(spark, sf_dir).filter(tx.words(F.col("text")) >= tx.MIN_WORDS).select("doc_id", F.substring("text", 1, tx.MAX_CHARS).alias("text"))


_phone_sql = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, '{tx.PHONE}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 10 AND 13)[1]"
_email_sql = lambda t: f"lower(nullif(regexp_extract({t}, '{tx.EMAIL}'), ''))"


@_query(f"SELECT doc_id, {_email_sql('text')} AS email, {_phone_sql('text')} AS phone, {_count('text', tx.URL)} AS url_count FROM documents")
def en_contacts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", tx.email(t).alias("email"), tx.phone(t).alias("phone"), F.regexp_count(t, F.lit(tx.URL)).alias("url_count"))


_TOKEN = r"[\p{L}\p{N}_]+"


@_query(f"""
WITH c AS (SELECT doc_id, {_count('text', _TOKEN)} AS resume_word_count, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS resume_line_count,
  {_count('text', tx.NUMBER)} AS numbers_count, {_count('text', tx.URL)} AS url_count FROM documents)
SELECT *, CASE WHEN resume_word_count BETWEEN 300 AND 700 THEN 1 ELSE 0 END AS is_length_optimal,
  CASE WHEN resume_word_count < 150 THEN 1 ELSE 0 END AS is_too_short, CASE WHEN resume_word_count > 1200 THEN 1 ELSE 0 END AS is_too_long FROM c""")
def g09_format_features(spark, sf_dir):
    t, n = F.col("text"), F.col("resume_word_count")
    docs = _docs(spark, sf_dir).select("doc_id", F.regexp_count(t, F.lit(_TOKEN)).alias("resume_word_count"), F.size(tx.full_lines(t)).alias("resume_line_count"), F.regexp_count(t, F.lit(tx.NUMBER)).alias("numbers_count"), F.regexp_count(t, F.lit(tx.URL)).alias("url_count"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return docs.select("*", flag(n.between(300, 700)).alias("is_length_optimal"), flag(n < 150).alias("is_too_short"), flag(n > 1200).alias("is_too_long"))


@_query("WITH r AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL SELECT 1000000000 + doc_id, lower(text) FROM (" + DUCKDB + ")) SELECT doc_id, " + ", ".join(f"{_any('t', w)} AS has_{k}_skills" for k, w in lx.CATEGORIES.items()) + ", " + ", ".join(f"{_any('t', w)} AS has_{k}" for k, w in lx.DEGREES.items()) + " FROM r")
def g03_g04_keyword_flags(spark, sf_dir):
    named = {**{f"has_{k}_skills": w for k, w in lx.CATEGORIES.items()}, **{f"has_{k}": w for k, w in lx.DEGREES.items()}}
    return with_layers_by_hits(_both(spark, sf_dir), lambda d: [{n: flag(d.any("t", w)) for n, w in named.items()}], ("t",)).select("doc_id", *named)


@_query("WITH r AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL SELECT 1000000000 + doc_id, lower(text) FROM (" + DUCKDB + ")) SELECT doc_id, " + ", ".join(f"{_sum('t', w)} AS {k}_count" for k, w in lx.EXTRAS.items()) + " FROM r")
def g07_keyword_counts(spark, sf_dir):
    named = {f"{k}_count": w for k, w in lx.EXTRAS.items()}
    return with_layers_by_hits(_both(spark, sf_dir), lambda d: [{n: d.count("t", w) for n, w in named.items()}], ("t",)).select("doc_id", *named)


_SECTIONS = f"""
WITH r AS ({DUCKDB}), s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM r),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM s),
h AS (SELECT *, CASE WHEN length(trim(line)) <= 60 AND NOT regexp_matches(trim(line), '[,;]$') THEN
  CASE trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} END END AS opens FROM e),
f AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
b AS (SELECT doc_id, section, pos, line FROM f WHERE opens IS NULL AND section IS NOT NULL AND trim(line) <> '')"""


_READY = _SECTIONS + f""", c AS (SELECT doc_id, count(DISTINCT section) AS section_count, count(*) FILTER (WHERE section = 'skills') AS skills_count,
  count(*) FILTER (WHERE section = 'projects') AS projects_count, count(*) FILTER (WHERE section = 'experience') AS experience_count FROM b GROUP BY doc_id),
m AS (SELECT c.*, {_email_sql('r.text')} AS email, {_phone_sql('r.text')} AS phone, len(regexp_extract_all(r.text, '\\S+')) AS n_words FROM c JOIN r USING (doc_id)),
p AS (SELECT doc_id, section_count, skills_count, projects_count, experience_count,
  CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 100 WHEN email IS NOT NULL OR phone IS NOT NULL THEN 50 ELSE 0 END AS contact_score,
  CASE WHEN n_words < 120 THEN 20 WHEN n_words < 200 THEN 40 WHEN n_words < 350 THEN 75 WHEN n_words < 900 THEN 100 WHEN n_words < 1400 THEN 85 WHEN n_words > 2000 THEN 50 ELSE 60 END AS length_score FROM m),
s2 AS (SELECT *, round(least(100.0, contact_score * 0.5 + least(skills_count, 10) * 2.5 + CASE WHEN projects_count > 0 THEN 15 ELSE 0 END + CASE WHEN experience_count > 0 THEN 10 ELSE 0 END), 2) AS candidate_score FROM p)
SELECT doc_id, section_count, skills_count, projects_count, experience_count, contact_score, length_score, CAST(candidate_score AS DOUBLE) AS candidate_score,
  CASE WHEN candidate_score >= 70 THEN 'Shortlisted' WHEN candidate_score >= 45 THEN 'Manual Review' ELSE 'Rejected' END AS decision FROM s2"""


@_query(_READY)
def qs_candidate_readiness(spark, sf_dir):
    texts = resumes(spark, sf_dir)
    count = lambda s: F.count(F.when(F.col("section") == s, 1))
    counts = section_lines(texts).groupBy("doc_id").agg(F.countDistinct("section").alias("section_count"), count("skills").alias("skills_count"), count("projects").alias("projects_count"), count("experience").alias("experience_count"))
    t = F.col("text")
    known = texts.select("doc_id", tx.contact_score(tx.email(t), tx.phone(t)).alias("contact_score"), tx.length_score(tx.words(t)).alias("length_score"))
    points = F.col("contact_score") * 0.5 + F.least(F.col("skills_count"), F.lit(10)) * 2.5 + F.when(F.col("projects_count") > 0, 15).otherwise(0) + F.when(F.col("experience_count") > 0, 10).otherwise(0)
    scored = counts.join(known, "doc_id").withColumn("candidate_score", F.round(F.least(F.lit(100.0), points), 2))
    return scored.withColumn("decision", tx.tier(F.col("candidate_score"), 70, 45))
