"""The join of tokens with the names most like them against a comparison of all pairs."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsift.functions import skills as sk
from docsift.operators import close_match as cm


def _tokens(names):
    r = random.Random(6)
    out = ["", "a", "abc", "aaaa", "aaaaaaaa", "pyhton", "javascritp", "kubernets", "nodejss", "ééééé"]
    for name in [n for n in names for _ in range(3)]:
        t = list(name)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", "x", "a", *t[:1]])
        out.append("".join(t))
    return out


@pytest.mark.parametrize(("names", "cutoff", "least"), [(sk.WHITELIST, 0.88, 4), (("aabb", "abab", "aaaab", "abcdefgh", "abcdefgg", "bcdefgha"), 0.8, 6)])
def test_same_as_all_pairs(spark, names, cutoff, least):
    tokens = _tokens(names)
    got = {r.token: r.name for r in cm.closest(spark.createDataFrame([(t,) for t in tokens * 2], "token string"), names, cutoff, least).collect()}
    want = {t: m[0] for t in tokens if len(t) >= least and (m := difflib.get_close_matches(t, names, 1, cutoff))}
    assert got == want and len(want) > 5


def test_arrays(spark):
    rows = [(1, ["python", "pyhton", None, "zzzz", "c"], "x"), (2, [], "x"), (3, None, "x"), (4, ["pyhton", "pyhton"], "x")]
    frame = spark.createDataFrame(rows, "doc_id int, t array<string>, token string")
    got = {r.doc_id: r.out for r in cm.with_closest(frame, "t", "out", ("python", "c"), 0.88, 4).collect()}
    # a transposition leaves five of six letters in place: 10 / 12
    assert got == {1: ["python", None, None, None, "c"], 2: [], 3: None, 4: [None, None]}
    got = {r.doc_id: r.out for r in cm.with_closest(frame, "t", "out", ("python", "c"), 0.82, 6).collect()}
    assert got[1] == ["python", "python", None, None, "c"] and got[4] == ["python", "python"]


def test_each_distinct_token_is_compared_once(spark, monkeypatch, tmp_path):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def counted(token: pd.Series, name: pd.Series) -> pd.Series:
        with open(f"{tmp_path}/pairs", "a") as out:
            out.writelines(f"{t} {n}\n" for t, n in zip(token, name, strict=True))
        return token.str.len() * 0.0 + 1

    monkeypatch.setattr(cm, "ratio", counted)
    tokens = spark.createDataFrame([("pythonn",)] * 50 + [("pythonx",)] * 50 + [("unlike",)] * 50, "token string").repartition(5)
    cm.closest(tokens, sk.WHITELIST, 0.88, 4).collect()
    assert sorted((tmp_path / "pairs").read_text().split("\n")[:-1]) == ["pythonn python", "pythonx python"]


def test_refuses_what_the_bound_does_not_hold(spark):
    tokens = spark.createDataFrame([("a",)], "token string")
    with pytest.raises(ValueError, match="bigram"):
        cm.closest(tokens, ("a",), 0.7, 2)
    with pytest.raises(ValueError, match="broadcast"):
        cm.closest(tokens, tuple(f"n{k}" for k in range(5001)), 0.88, 4)


def test_null_and_empty(spark):
    tokens = spark.createDataFrame([(None,), ("",)], "token string")
    assert cm.closest(tokens, ("python",), 0.88, 4).count() == 0
    assert cm.closest(tokens.filter(F.lit(False)), ("python",), 0.88, 4).count() == 0
