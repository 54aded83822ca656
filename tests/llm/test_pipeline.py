"""The stages and run() on awkward tables, and the catch of planted passages through the suffix stage."""

import random

import pytest

import corpus_pipeline as pipeline

#: Names that the operators use themselves.
CLASHES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "packed", "hits", "text_key", "wanted", "row", "bad_id", "node", "label", "size", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def _row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), *CLASHES)


def _prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_passages_are_cut(spark):
    r = random.Random(11)
    plants = [_prose(r, r.randint(51, 80)) for _ in range(40)]
    rows = [_row(k, f"{_prose(r, r.randint(20, 200))} {plants[k % 40]} {_prose(r, r.randint(20, 200))}") for k in range(120)]
    clean = [_row(200 + k, _prose(r, r.randint(30, 300))) for k in range(80)]
    out = {x.doc_id: x.text for x in pipeline.cut_repeats(spark, _frame(spark, rows + clean), "").collect()}
    # whatever their bytes: the first document keeps its plant, the others lose just that
    assert {len(p) // 100 for p in plants} >= {3, 4}
    assert all(out[k] == (rows[k][1] if k < 40 else rows[k][1].replace(plants[k % 40] + " ", "")) for k in range(120))
    assert all(out[x[0]] == x[1] for x in clean)


def test_short_words_are_passages_too(spark):
    plant = " ".join("ab" for _ in range(10)) + " " + " ".join(f"{k:x}" for k in range(41))
    rows = [_row(1, f"one {plant} two"), _row(2, f"three\n{plant}\nfour"), _row(3, plant[:-4])]
    out = {x.doc_id: x.text for x in pipeline.cut_repeats(spark, _frame(spark, rows), "").collect()}
    assert out == {1: rows[0][1], 2: "three\nfour", 3: rows[2][1]}


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(3)
    a, b, c = (_prose(r, 90) for _ in range(3))
    return [_row(None, a), _row(1, a), _row(1, a), _row(2, b), _row(2, c), _row(3, None, None), _row(4, ""), _row(5, "one"), _row(6, _prose(r, 20000)), _row(None, None)]


def test_near_copies_keep_one_of_each(spark, awkward):
    got = pipeline.drop_near_copies(spark, _frame(spark, awkward), "")
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    # the copies of a are one, b and c of one doc_id both stay, of the empty texts the smallest doc_id stays
    assert sorted((x.doc_id is None, x.doc_id or 0, len(x.text or "")) for x in got.collect()) == sorted((x[0] is None, x[0] or 0, len(x[1] or "")) for x in [awkward[1], *awkward[3:6], *awkward[7:9]])


def test_cut_repeats_awkward(spark, awkward):
    got = pipeline.cut_repeats(spark, _frame(spark, awkward), "")
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    rows = got.collect()
    assert len(rows) == len(awkward) and all(x.kept_text == "kept_text" and x.n_chars == len(x.text) for x in rows)
    # rows of one doc_id are one document, whose copies stay; none has lost anything to the row without doc_id
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in rows) == sorted((x[0] is None, x[0] or 0, x[1] or "") for x in awkward)
    assert pipeline.cut_repeats(spark, _frame(spark, []), "").count() == 0


def test_leaks_go_with_any_doc_id(spark, awkward, tmp_path):
    spark.createDataFrame([(1, awkward[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.drop_leaks(spark, _frame(spark, awkward), str(tmp_path))
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, awkward[3:]))
    assert pipeline.drop_leaks(spark, _frame(spark, []), str(tmp_path)).count() == 0


def test_run(spark, awkward, tmp_path):
    r = random.Random(8)
    good, bad = [_row(100 + k, _prose(r, 150).capitalize() + ".") for k in range(60)], [_row(300 + k, "@#$ 99 !!! " * 40 + str(k)) for k in range(60)]
    leaked = _row(500, good[0][1][:40] + " " + (item := _prose(r, 40)))
    docs = _frame(spark, [*awkward, *good, *bad, leaked])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(100, 160)] + [(k, 0) for k in range(300, 360)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = [x.doc_id for x in got]
    assert set(range(100, 160)) <= set(ids) and not set(range(300, 360)) & set(ids) and 500 not in ids
    assert len(ids) == len(set(ids)) + ids.count(2) - 1 and all(x.taken <= 3 * x.size for x in got)
    again = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty_tables_and_clashing_names(spark, awkward, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, score string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        got = stage(spark, _frame(spark, []), str(tmp_path))
        assert got.count() == 0, name
        kept = stage(spark, _frame(spark, awkward), str(tmp_path))
        assert kept.count() > 0 and (name == "source_mixing" or kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]), name
    assert pipeline.keep_quality(spark, _frame(spark, awkward), str(tmp_path)).count() == len(awkward)
    assert pipeline.mix_sources(spark, _frame(spark, awkward), str(tmp_path)).count() == len(awkward)
    assert pipeline.run(spark, str(tmp_path)).count() == 0
