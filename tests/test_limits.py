"""Limits of size and time, deletion, and word lists of any length."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docsift.operators import projects as pj
from docsift.operators.deadline import Overdue, limited
from docsift.plans import builder_queries
from docsift.sources import files, lookup


def test_large_files_are_never_opened(spark, tmp_path):
    with open(tmp_path / "huge.pdf", "wb") as f:
        f.truncate(3 << 30)  # over what a row can hold
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DOCX").write_bytes(b"x")
    (tmp_path / "b.Pdf").write_bytes(b"y")
    (tmp_path / "c.txt").write_bytes(b"z")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {"huge.pdf": "too_large", "huge.bin": "unsupported", "a.DOCX": "ok", "b.Pdf": "ok", "c.txt": "unsupported"}
    assert {k for k, r in got.items() if r.content is not None} == {"a.DOCX", "b.Pdf"} and got["huge.pdf"].length == 3 << 30
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.extract_text(files.list_files(spark, str(tmp_path))).collect()}
    assert errors["huge.pdf"] == "too_large" and errors["b.Pdf"] == "no pdf reader" and errors["a.DOCX"].startswith("BadZipFile")


def test_limited():
    assert limited(5, lambda x: x + 1, 1) == 2
    with pytest.raises(Overdue, match="over 0.2 s"):
        limited(0.2, time.sleep, 5)
    with pytest.raises(KeyError):
        limited(5, {}.__getitem__, 1)


def test_limited_outside_the_main_thread():
    import concurrent.futures as cf

    with cf.ThreadPoolExecutor(1) as pool:
        assert pool.submit(limited, 5, len, "abc").result() == 3
        with pytest.raises(Overdue):
            pool.submit(limited, 0.1, time.sleep, 1).result()
        with pytest.raises(KeyError):
            pool.submit(limited, 5, {}.__getitem__, 1).result()


def test_a_file_that_hangs_has_an_error(spark, tmp_path):
    (tmp_path / "slow.pdf").write_bytes(b"slow")
    (tmp_path / "fast.pdf").write_bytes(b"fast")

    def read(content):
        while content == b"slow":
            pass
        return "text"

    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract_text(files.list_files(spark, str(tmp_path)), read, deadline=1).collect()}
    assert got == {"slow.pdf": (None, "Overdue: over 1 s"), "fast.pdf": ("text", None)}


def test_a_record_that_hangs_has_a_status(spark, monkeypatch):
    real = pj.cut_projects

    def cut(lines):
        while any("hang" in x for x in lines):
            pass
        yield from real(lines)

    monkeypatch.setattr(pj, "cut_projects", cut)
    docs = spark.createDataFrame([(1, "RAVI SHAH\nPROJECTS\nhang: built with html css and python for people", None), (2, "Asha Dave\nSKILLS\nPython", None), (3, None, "unreadable")], "doc_id long, text string, error string")
    got = {r.doc_id: r for r in builder_queries.records(spark, docs, keep=("error",), deadline=1).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "projects: over 1 s", 2: "ok", 3: "unreadable"}
    assert got[1].name == "RAVI SHAH" and got[2].skills == ["python"]
    builder_queries.records(spark, docs.drop("error"))  # the UDF as it was


def test_purge(spark, tmp_path):
    old, now = time.time() - 10 * 24 * 3600, time.time()
    for name, at in {"old.pdf": old, "new.pdf": now, "old.docx": old, "old.txt": old}.items():
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (at, at))
    assert files.purge(spark, str(tmp_path)) == {"stale": 2, "deleted": 0, "changed": 0, "failed": 0} and len(list(tmp_path.glob("*.*"))) >= 4
    assert files.purge(spark, str(tmp_path), delete=True) == {"stale": 2, "deleted": 2, "changed": 0, "failed": 0}
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"new.pdf", "old.txt"}


def test_what_was_written_meanwhile_stays(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"x")
    monkeypatch.setattr(files, "stale", lambda found, hours: found.select("path"))  # a listing from before
    os.utime(tmp_path / "b.pdf", (1, 1))
    assert files.purge(spark, str(tmp_path), 1, delete=True) == {"stale": 2, "deleted": 1, "changed": 1, "failed": 0} and (tmp_path / "a.pdf").exists()


@pytest.mark.parametrize(("literal", "broadcast", "form"), [(500, 1000, "literal"), (2, 1000, "broadcast"), (2, 3, "shuffle")])
def test_lookups(spark, tmp_path, literal, broadcast, form):
    (tmp_path / "words.txt").write_text("# list\nGit\n docker \ngit\nsql\njava\n\n")
    words = lookup.wordlist(spark, str(tmp_path / "words.txt"))
    assert lookup.form_of(words, literal, broadcast) == form
    rows = spark.createDataFrame([(1, "git"), (2, "go"), (3, None), (4, "java"), (4, "java")], "id int, w string")
    got = lookup.with_known(rows, "w", words, "known", literal, broadcast)
    assert sorted((r.id, r.known) for r in got.collect()) == [(1, True), (2, False), (3, False), (4, True), (4, True)] and got.columns == ["id", "w", "known"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (form != "literal")
    assert [r.w for r in lookup.unknown(rows, "w", words, broadcast).collect()] == ["go"]
    assert lookup.with_known(rows, "w", words.filter(F.lit(False)), "known").filter("known").count() == 0
