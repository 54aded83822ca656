"""What the findings of round 4 were about, each on a few rows."""

import difflib
import random

import duckdb
import pytest

from docsift.functions import skills as sk
from docsift.functions.dialect import JAVA_WHITE, WHITE, spelled
from docsift.operators import projects as pj
from docsift.plans import queries


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of given documents, with one candidate."""

    def made(*texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(7,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
        return str(tmp_path)

    return made


def test_all_lines_have_project_texts(spark, tables):
    """names and descriptions of the lines after the sixtieth too, in the query and in its SQL."""
    sf = tables("\n".join(f"Project {k}: line {k}" for k in range(100)))
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = {r.doc_id: r.names_ for r in queries.QUERIES["nb8_project_texts"](spark, sf).collect()}
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, names_ FROM ({queries.ORACLES['nb8_project_texts']})").fetchall()}
    assert got == want and got[0].count("|") == 99


@pytest.mark.parametrize("name", ["nb2_build_skills", "nb7_projects", "nb14_records"])
def test_projects_are_cut_to_their_end(spark, tables, monkeypatch, name):
    """F8: queries without a status have no deadline whose nulls look like results."""
    sf = tables("RAVI SHAH\nSKILLS\nPython\nPROJECTS\nShop Front\nbuilt with deep learning in python for many people")
    sure = {repr(tuple(r)) for r in queries.QUERIES[name](spark, sf).collect()}

    def late(seconds, f, *args):
        raise pj.Overdue("over 0 s")

    monkeypatch.setattr(pj, "limited", late)
    assert {repr(tuple(r)) for r in queries.QUERIES[name](spark, sf).collect()} == sure


def test_records_of_documents_too(spark, tables):
    """the records are those of all documents and all candidates."""
    sf = tables("RAVI SHAH\nSKILLS\nPython", "Asha Dave")
    assert {r.doc_id: r.name for r in queries.QUERIES["nb14_records"](spark, sf).select("doc_id", "name").collect()}.keys() == {0, 1, 1000000007}


def test_close_candidates_lose_no_match():
    """few names are compared with a token, and the closest is among them."""
    r = random.Random(4)
    tokens = ["", "a", "aaaa", "pyhton"]
    for name in sk.WHITELIST:
        t = list(name)
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", "x", *t[:1]])
        tokens.append("".join(t))
    want = [difflib.get_close_matches(t, sk.WHITELIST, 1, sk.CUTOFF) for t in tokens]
    assert [[s] if (s := sk.close_skill(t)) else [] for t in tokens] == want and sum(map(len, want)) > 50
    assert sum(len(sk.close_candidates(t, sk.WHITELIST, sk.CUTOFF)) for t in tokens) < 5 * len(tokens)


def test_misspelt_skills_are_found_in_one_pass(spark, tables):
    """texts are cut into tokens once and never shuffled by them."""
    got = queries.QUERIES["nb1_skills"](spark, tables("pyhton, dockr\nkubernets"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.filter("doc_id = 0").first()
    assert (row.found_, row.n_typos) == ("docker|kubernetes", 2)  # two letters changed places: a ratio of 10 / 12


@pytest.mark.parametrize("p", ["[^a-z0-9#+ ]", r"\[a-z[0-9]\]", rf"[^{WHITE}]+", r"(?i)[A-Z._%+\-]+@[\]a-c]?", r"a-z[A-Z]"])
def test_ranges_spelled_out_match_the_same(spark, p):
    """The pattern that Spark is given finds what it found with ranges."""
    p = p.replace(WHITE, JAVA_WHITE)
    text = "".join(map(chr, range(1, 0x250))) + "\u2003\u2028x a-zA [q7] Az@]b a\u212a [a-z7]"
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.selectExpr(f"regexp_extract_all(t, r'{spelled(p)}', 0) AS a", f"regexp_extract_all(t, r'{p}', 0) AS b").first()
    assert got.a == got.b and got.a and "a-z0" not in spelled(p)
