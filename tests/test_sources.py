"""Word lists, configuration, synthetic rows, model files, pages and the stream of an inbox."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.operators import model_files, models
from docsift.sources import files, registry
from docsift.streaming.inbox import stream_records

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_word_lists(spark, tmp_path):
    (tmp_path / "tools.txt").write_text("# tools\nGit\n docker \n")
    (tmp_path / "own.txt").write_text("x\n")
    lists = registry.WordLists(spark, str(tmp_path))
    assert lists.load("tools") == {"git", "docker"} and lists.load("own.txt") == {"x"} and lists.load("skills") == frozenset()
    assert lists.load("tools") and lists.stats() == {"lists": 2, "words": 3, "hits": 1, "misses": 3}
    with pytest.raises(registry.MissingList):
        lists.load("frameworks", required=True)
    assert lists.preload(("tools", "skills")) == {"tools": {"git", "docker"}, "skills": frozenset()} and lists.is_loaded("tools")
    lists.clear()
    assert not lists.is_loaded("tools") and len(registry.LISTS) == 11


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("inference_rules:\n  limits:\n    max_shortlisted: 10\nactive_model: logistic_regression\n")
    config = registry.load_config(spark, str(tmp_path / "c.yaml"))
    assert registry.config_value(config, "inference_rules.limits.max_shortlisted") == 10
    assert registry.config_value(config, "inference_rules.none.max", 3) == 3 and registry.config_value(config, "active_model") == "logistic_regression"


def test_synthetic_rows(spark):
    rows = registry.synthetic_rows(spark, 100)
    got = rows.collect()
    assert len(got) == 99 and {r.label for r in got} == {0, 1, 2} and sorted(map(repr, got)) == sorted(map(repr, registry.synthetic_rows(spark, 100).collect()))
    for r in got:
        low, high = ((1, 5), (4, 9), (8, 15))[r.label]
        assert low <= r.skills_count <= high and r.has_name == 1 and 0 <= r.experience_years_estimate <= 5 and (r.is_fresher == 1) == (r.label == 0)
    assert sorted(map(repr, registry.synthetic_rows(spark, 100, seed=1).collect())) != sorted(map(repr, got))
    data = registry.dataset_rows(rows, ("skills_count", "cgpa_value", "absent"))
    assert data.columns == ["id", "label", "skills_count", "cgpa_value", "absent"] and data.filter("absent <> 0").count() == 0


def test_feature_registry(spark):
    features = registry.FeatureRegistry()

    @features.register("twice")
    def twice():
        return F.col("id") * 2

    features.register("none")(lambda: F.lit(None).cast("int"))
    assert features.names() == ("twice", "none") and features.size() == 2
    assert [tuple(r) for r in features.compute(spark.range(2)).collect()] == [(0, 0, 0), (1, 2, 0)]
    with pytest.raises(registry.DuplicateFeature):
        features.register("twice")(twice)
    with pytest.raises(ValueError):
        features.register("")
    features.clear()
    assert features.size() == 0


def test_model_files(spark, tmp_path):
    names = ("skills_count", "projects_count")
    rows = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 3 * 4).alias("skills_count"), (F.col("id") % 2).alias("projects_count"))
    for kind in ("logistic_regression", "random_forest"):
        model = models.train(rows, names, kind)
        about = model_files.ModelMetadata("m1", kind, "1.0", feature_names=list(names), performance_metrics={"auc": 0.5})
        model_files.save_model(spark, model, about, str(tmp_path / kind))
        back, told = model_files.load_model(spark, str(tmp_path / kind))
        assert told == about and told.features_count == 2
        both = [sorted((r.id, r.label, [round(p, 9) for p in r.probs]) for r in models.predict(rows, names, m).collect()) for m in (model, back)]
        assert both[0] == both[1]
    with pytest.raises(ValueError):
        model_files.save_model(spark, object(), about, str(tmp_path / "x"))


def test_page_text(spark):
    block = "struct<x0: double, y0: double, x1: double, text: string>"
    left = [(0.0, float(k), 90.0, f"left words {k}") for k in range(5)]
    right = [(110.0, float(k), 200.0, f"right words {k}") for k in range(5)]
    told = [(0.0, 9.0, 190.0, "Farm Tool: helps to sow seeds by hand and by day and by night in rain and in the sun of may")]
    rows = [(1, 1, 200.0, [*right, *left]), (2, 1, 200.0, told), (3, 1, 200.0, [(0.0, 0.0, 1.0, "few")])]
    pages = spark.createDataFrame(rows, f"doc_id long, page int, width double, blocks array<{block}>")
    plain = spark.createDataFrame([(3, "all\rof it"), (2, "unused")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in files.page_text(pages, plain).collect()}
    assert got[1] == "\n".join([f"left words {k}" for k in range(5)] + [f"right words {k}" for k in range(5)])
    assert got[2].split("\n\n[RECOVERED_PROJECTS]\n")[1].startswith("Farm Tool: helps to sow") and got[3] == "all\nof it"


def test_inbox_stream(spark, tmp_path):
    lines = ["RAVI KUMAR", "ravi@x.in", "SKILLS", "Python, Docker"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)}</w:body></w:document>')
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(out.getvalue())
    (inbox / "b.docx").write_bytes(b"broken")
    run = lambda: stream_records(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert run()
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert (got["a.docx"].name, got["a.docx"].skills, got["a.docx"].error) == ("RAVI KUMAR", ["python", "docker"], None) and got["b.docx"].error.startswith("BadZipFile")
    (inbox / "c.docx").write_bytes(out.getvalue())
    assert run() and spark.read.json(str(tmp_path / "out")).count() == 3
