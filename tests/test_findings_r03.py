"""What the findings of round 3 were about, each on a few rows."""

import re

import duckdb
import pytest

from docsift.functions import cleaning as cl
from docsift.functions import skills as sk
from docsift.functions.dialect import WHITE, DuckDB, Spark
from docsift.operators import spelling as sp
from docsift.operators.close_match import longest, with_closest
from docsift.plans import queries  # noqa: F401 - it registers them
from docsift.plans.rough import QUERIES, with_layers
from docsift.plans.sectioned import CLEAN_SECTIONS


@pytest.mark.parametrize("text", ["be a a ator and a a a", "x I I I's, tha a a tnd a a a b", "a b c a b cd", "a a\na a, ba a\na ab", "a " * 5000 + "a, ba a ab"])
def test_letters_are_closed_within_words_too(spark, text):
    """a run of single letters loses its blanks wherever it stands again, as in the SQL."""
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{cl.close_letters(Spark(), 't')} AS t").first().t
    assert got == duckdb.execute(f"SELECT {cl.close_letters(DuckDB(), 't')} FROM (SELECT ?::VARCHAR AS t)", [text]).fetchone()[0]


def test_only_what_is_asked_for_is_sorted_with_the_lines(spark):
    """of a document only its key goes with its lines if nothing else is asked for, and its text is shuffled once."""
    docs = spark.createDataFrame([(1, "Skills\nPython")], "doc_id long, text string")
    got = CLEAN_SECTIONS.frame(docs).select("doc_id", "section_names")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().section_names == ["skills"] and len(set(re.findall(r"first\((row_\w*)#", plan))) == 1 and "named_struct(doc_id" not in plan
    assert plan.count("RepartitionByExpression") == 1


def test_stripped_as_by_the_pattern(spark):
    """Whatever white space there is, within and at both ends."""
    texts = [f"{a}x{b} y{c}" for a in ("", " \t", " 　") for b in ("", "\n") for c in ("", "\r\n", "\xa0\x85", "\x1f ​")] + ["", " \n ", "é ß "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{Spark().strip('t')} AS s").collect()
    assert [r.s for r in got] == [duckdb.execute(f"SELECT {DuckDB().strip('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in texts]


def test_long_tokens_are_not_cut_into_bigrams(spark):
    """a paragraph without breaks matches no name and is left out before its bigrams, a quadratic number of looks."""
    docs = spark.createDataFrame([(1, ["kubernets", "word " * 4000]), (2, ["x" * 20000, "pyhton", "python"])], "doc_id long, tokens array<string>")
    made = with_closest(docs, "tokens", "found", ("kubernetes", "python"), 0.88, 4).select("doc_id", "found")
    assert longest(("kubernetes", "python"), 0.88) == 12
    assert {r.doc_id: r.found for r in made.collect()} == {1: ["kubernetes", None], 2: [None, None, "python"]}


def test_typos_by_one_look_at_each_token(spark):
    """the places of skills by a few looks, as by the SQL that looks at all pairs of tokens."""
    texts = ["python, pyhton, docker: python, x: dockr, java, java, Java", "dockr, docker, a: dockr", "", "none here"]
    known = {"pyhton": "python", "dockr": "docker", "python": "python", "docker": "docker", "java": "java"}
    match = lambda d: lambda tokens: d.each(tokens, "x", "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in known.items()) + " END")
    frame = with_layers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sk.extracted(Spark(), "text", "found", match(Spark())))
    sql = "SELECT ?::VARCHAR AS text"
    for layer in sk.extracted(DuckDB(), "text", "found", match(DuckDB())):
        sql = f"SELECT *, {', '.join(f'{DuckDB().render(v)} AS {k}' for k, v in layer.items())} FROM ({sql})"
    want = [duckdb.execute(f"SELECT found, found_typos FROM ({sql})", [t]).fetchone() for t in texts]
    assert [(r.found, r.found_typos) for r in frame.orderBy("doc_id").collect()] == want and want[0][1] == 1
    assert "found_places" in frame.columns


def test_typos_in_one_pass_over_the_texts(spark):
    """no word is joined or put in order by its place, and the counts are those of the list of words in the row."""
    texts = ["Programing databse vehicleregistration abcuniversity a@b.in x@ http://x.y/zzzzz tiny", "databse ÉProgramingx under_score Kelvinx @lone lone@@twice", "databse", "", None, "wordy " * 2500 + "beyond thousand", "programing a@b@c", "x" * 25 + " sevrers9 sevrers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = sp.count_rare(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("LogicalRDD") == 1
    checked = with_layers(docs.selectExpr("doc_id", "coalesce(text, '') AS raw"), sp.checked_words(Spark(), "raw")).select("doc_id", "checked").collect()
    words = {r.doc_id: r.checked for r in checked}
    rare = {w for w in set().union(*words.values()) if sum(w in v for v in words.values()) < 3}
    want = {k: (len(rare & set(v)), len(v)) for k, v in words.items()}
    assert {r.doc_id: (r.typo_count, r.total_words) for r in made.collect()} == want and want[0][0] and want[5][1] == 2000


@pytest.mark.parametrize("name", ["se10_classifier_a", "se11_classifier_b", "se12_confident_classes"])
def test_contents_are_read_once(spark, name):
    """no filter of the optimizer makes the lines anew before they are dealt to rows, and names that share a content
    come after it has been classified."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and "size(" in x]
    at = lambda sign: next(k for k, x in enumerate(plan) if sign in x)
    assert at("Generate explode(items") < at("ArrowEvalPython") < at("Generate explode(contents")


@pytest.mark.parametrize("p", [f"[{WHITE}]", f"[^{WHITE}]", rf"[0-9{WHITE}\-.]", rf"[^@{WHITE}x]", rf"[\p{{L}}\x27\-`{WHITE}]"])
def test_white_space_of_java_patterns(spark, p):
    """classes of white space that are quick on ASCII hold the same characters, negated and mixed ones too."""
    assert Spark().lit(p) != f"r'{p}'"
    chars = spark.range(1, 0x20000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    assert chars.filter(f"regexp_like(c, {Spark().lit(p)}) = regexp_like(c, r'{p}')").count() == 0x1FFFF - 2048
