"""Keyword flags and counts by hit lists against substring tests."""

import random

import pytest

from docsift.functions import features
from docsift.functions.dialect import Spark
from docsift.operators import keyword_hits as kh
from docsift.plans.rough import with_layers

WORDS = ("java", "javascript", "script", "a", "b.e", "be", "sql", "sql injection", "c++", "react native", "native", "é", "ava", *[f"w{k}" for k in range(150)])


def _texts():
    r = random.Random(2)
    return [None, "", "java", "javascript", "sqlsql injectio", "b.ebe", *("".join(r.choice([*WORDS, " ", "x", "jav", "sql inj"]) for _ in range(r.randrange(12))) for _ in range(80))]


def test_masks():
    for text in _texts():
        if text is None:
            assert kh.masks(text, WORDS) is None
            continue
        got = kh.masks(text, WORDS)
        assert [w for k, w in enumerate(WORDS) if got[k // kh.BITS] >> k % kh.BITS & 1] == [w for w in WORDS if w in text]


def test_flags_and_counts(spark):
    groups = {"one": ("java",), "more": WORDS[2:9], "far": WORDS[70:160], "all": WORDS}
    layers = lambda d: [{"t": "lower(text)"}, {f"any_{k}": d.any("t", w) for k, w in groups.items()} | {f"n_{k}": d.count("t", w) for k, w in groups.items()}, {"other": d.any("text", ("sql",))}]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(_texts())], "doc_id int, text string")
    want = with_layers(frame, layers(Spark())).fillna(False).fillna(0)
    got = kh.with_layers_by_hits(frame, layers, ("t", "unused")).fillna(False)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_every_feature(spark):
    r = random.Random(4)
    words = [w for v in (features.ALL_TECH, features.DEGREE) for w in v] + ["Hackathon", "open source", "led 3", "2019 - 2021", "\n"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))
    arrays = ("skills", "edu", "exp", "proj", "ach", "langs", "skill_lines", "sections")
    rows = [(k, "\n".join(line() for _ in range(5)), "A B", "a@b.c", "9876543210", "Pune", 3, *[[line() for _ in range(r.randrange(4))] for _ in arrays]) for k in range(60)]
    kind = "doc_id long, raw string, name string, email string, phone string, location string, section_lines int, " + ", ".join(f"{a} array<string>" for a in arrays)
    frame = spark.createDataFrame(rows, kind)
    got = kh.with_layers_by_hits(frame, features.layers, features.SCANNED).select("doc_id", *features.ALL)
    want = with_layers(frame, features.layers(Spark())).select("doc_id", *features.ALL)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # one pass a text for all keywords
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2


@pytest.mark.parametrize("words", [("x",), tuple(f"k{k}" for k in range(64))])
def test_width(words):
    assert len(kh.masks(words[-1], words)) == -(-len(words) // kh.BITS) and kh.masks(words[-1], words)[-1] > 0
