"""A training corpus from ``documents``: quality, near copies, repeated passages, leaked test items, source mix.

Each stage is a function of (session, docs, folder of the tables) and works on what the stage before it kept. All but
the last return the columns of ``documents``; the last returns every remaining document with the words the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontaminate, mixing, near_copies, quality, simhash, suffix_dedup
from docsift.llm.shared import persisted, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from those of its labelled rows that are in docs.

    A null text is scored as an empty one; repeated rows get one score each and stay or go together; a score at the
    threshold stays; without labels every score is one half and
    all stay; an empty table gives an empty result; other columns may have any names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(quality.train_rows(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each component of SimHash fingerprints, as op10 links them; of those that
    remain, which no radius of fingerprints tells apart in full, one of each group whose five-word shingles have a Jaccard
    similarity of 0.8 or more.

    Groups are of texts, so rows without doc_id and unlike texts with one doc_id stay; a null doc_id comes last."""
    return near_copies.one_of_each(persisted(simhash.one_of_each(docs)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over fifty words that a smaller doc_id has, or the same document earlier, so that one copy of each
    stays; n_chars is counted again where words went.

    A null text becomes empty; a row without doc_id is kept as it is and is nobody's source; rows with one doc_id are one
    document for the order, and what they share stays; texts of any length are judged whole; an empty table gives an
    empty result; other columns may have any names."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    # the text goes along packed, not in the rows
    kept = suffix_dedup.remove_repeated_passages(docs, keep=[c for c in docs.columns if c not in new])
    return kept.select(*[new.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with or without doc_id.

    Null texts stay; of rows with one doc_id those go whose own text holds an item, and repeated rows go together; an empty
    benchmark drops nothing, an empty table gives an empty result; texts are searched whole; other columns may have any names."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.

    A null text has none and is still returned; a null source is one of its own, the last; rows without doc_id, repeated
    rows and ties get their own draws, placed by md5; an empty table gives an empty result; other columns are not read."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: Hashing, sorting and learned scores have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to ``documents``, each result written as Parquet in the shared folder and read again. Awkward rows
    are treated as each stage says; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
