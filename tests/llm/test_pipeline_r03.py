"""Findings of round 3 about the pipeline."""

import corpus_pipeline as pipeline
from docsift.llm import simhash


def test_near_copies_are_those_of_the_fingerprints_first(spark):
    """what SimHash links is one, shingles follow for what it leaves."""
    words = [f"w{k * k % 997}" for k in range(300)]
    near = [*words[:150], "other", *words[151:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words).upper()), (None, "alone here"), (4, "ALONE here"), (5, None), (6, " "), (7, "far " + " ".join(words[::-1])), (8, "short one"), (8, "short two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.filter("doc_id < 8")).collect()}
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.one_of_each(docs).collect())
    assert kept == sorted([(k, dict(rows)[k] or "") for k in sorted(set(same.values()))] + [(8, "short one"), (8, "short two")])
    assert same[3] == 1 and same[4] == 4 and same[6] == 5 and same[7] == 7
    # the shingles see the one changed word, whatever the fingerprints say
    got = sorted((r.doc_id, r.text or "") for r in pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([rows[0], rows[4], (5, ""), *rows[7:]])


def test_the_stage_uses_the_fingerprints(spark, monkeypatch):
    asked = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or real(*a, **k))
    pipeline.drop_near_copies(spark, spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), "").collect()
    assert asked
