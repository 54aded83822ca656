import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.functions import features, rules
from docsift.operators import models
from docsift.plans.profiles import profiles, with_features
from docsift.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(lines, rows=()):
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(map(p, lines))}<w:tbl>{table}</w:tbl></w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    good = docx(["ASHA PATEL", "SKILLS", "Python"], [("a", "b")])
    for name, data in {"a.docx": good, "b.docx": b"broken", "c.pdf": b"%PDF", "d.docx": b"", "e.txt": b"x", "f.docx": docx(["one"])}.items():
        (tmp_path / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.text, (r.error or "").split(":")[0]) for r in files.extract_text(listed).collect()}
    assert got["a.docx"] == ("ASHA PATEL\nSKILLS\nPython\na b", "")
    assert {k: v[1] for k, v in got.items() if k != "a.docx"} == {"b.docx": "BadZipFile", "c.pdf": "no pdf reader", "e.txt": "unsupported", "f.docx": "ValueError"}
    pdf = files.extract_text(listed, lambda b: b.decode()).filter("path LIKE '%c.pdf'").collect()
    assert [(r.text, r.error) for r in pdf] == [("%PDF", None)]
    assert files.stale(listed).count() == 0 and files.stale(listed, -1).count() == 5


def test_records(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# words\n Java \njava\n\nGo\n")
    assert files.load_wordlist(spark, str(tmp_path / "w.txt")) == ("go", "java")
    with pytest.raises(ValueError):
        files.load_wordlist(spark, str(tmp_path / "w.txt"), 1)
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "slug string, x double, y double")
    files.write_records(rows, str(tmp_path / "json"))
    back = files.load_records(spark, str(tmp_path / "json"), ("x", "y", "z"))
    assert sorted(map(tuple, back.collect())) == [("a", None, 1.0, 0.0, 0.0), ("b", None, 2.0, 3.0, 0.0)]
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["slug", "x", "y"]


TEXT = """ASHA PATEL
asha@mail.com 98765 43210
Surat
Skills
Python, Docker / git
Education
B.Tech Computer Science CGPA: 8.5 2024
Experience
Led 4 engineers at Acme Technologies, 2019 - 2021
Projects
Shop: built with mysql and docker, deployed for a team
"""


def test_features_by_hand(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.asDict() for r in with_features(profiles(texts)).select("doc_id", *features.ALL).collect()}
    want = {
        "has_name": 1, "has_email": 1, "has_phone": 1, "has_location": 1, "contact_completeness_score": 1.0, "section_count": 4, "section_completeness_score": 1.0,
        "skills_count": 3, "programming_languages_count": 1, "tool_count": 2, "skill_weight_score": 5.0, "cgpa_value": 85.0, "graduation_year": 2024, "has_btech_be": 1,
        "experience_years_estimate": 2.0, "experience_has_internship": 0, "has_full_time_experience": 1, "experience_company_count": 1, "is_fresher": 0, "projects_count": 1,
        "avg_project_desc_length": 10.0, "has_deployed_project": 1, "quantified_impact_count": 1, "action_verb_count": 2, "ats_penalty_too_short": 1, "ats_penalty_no_contact": 0,
    }
    assert {k: rows[1][k] for k in want} == want
    assert len(features.ALL) == len(set(features.ALL)) == 155
    assert all(v is not None for r in rows.values() for v in r.values())
    assert {**rows[2], "doc_id": 3} == rows[3] and rows[3]["section_count"] == 0 and rows[3]["is_fresher"] == 1


def test_models(spark):
    names = ("skills_count", "projects_count", "absent")
    base = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("label"), ((F.col("id") % 3) * 4 + F.col("id") % 2).alias("skills_count"), (F.col("id") % 3).alias("projects_count"))
    model = models.train(base, names)
    got = models.predict(base, names, model)
    assert got.join(base.select("id", F.col("label").alias("want")), "id").filter("label = want").count() == 90
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.label_name == models.LABEL_NAMES[r.label] for r in got.collect())
    assert [n for n, _ in models.importance(model, names)][-1] == "absent"
    assert all(len(r.positive) <= 1 and all(x["value"] > 0 for x in r.positive) for r in models.explain(base, names, model, 1).collect())
    with pytest.raises(models.OneClass):
        models.train(base.filter("label = 1"), names)
    with pytest.raises(NotImplementedError):
        models.train(base, names, "xgboost")
    assert len(rules.MODEL_INPUTS) == 18
