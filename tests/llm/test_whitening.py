"""Whitening against covariances formed row by row."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from docsift.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def _brute(rows):
    """Usable (vec_id, x), exact sums, covariance."""
    whole = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit]
    return whole, n, sums, np.array([[math.fsum(r[i] * r[j] for r in centred) / n for j in range(len(sums))] for i in range(len(sums))])


def _rows(count, d, seed=1):
    r = random.Random(seed)
    base = [[r.gauss(0, 3) * (1 + j) for j in range(d)] for _ in range(count)]
    for v in base:
        v[-1] = v[0] * 0.5 + r.gauss(0, 0.1)  # nearly dependent
    return base


def _check(spark, rows, folder, components):
    spark.createDataFrame([(k, v, "clash") for k, v in rows], SCHEMA).repartition(7).write.parquet(f"{folder}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(folder)).collect()
    whole, n, sums, cov = _brute(rows)
    assert len(got) == len(whole) * components
    values, vectors = np.linalg.eigh(cov)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, components + 1))
    deviation = {}
    for k, x in whole:
        deviation.setdefault(k, set()).add(sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)))
    assert all(r.deviation in deviation[r.vec_id] and r.n == n and r.identity_error < 1e-8 for r in got)
    for c in by:
        e, v = values[-c], vectors[:, -c]
        assert by[c][0].explained == pytest.approx(e / values.sum(), rel=1e-6)
        want = {}
        for k, x in whole:
            want.setdefault(k, []).append(float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)], v) / math.sqrt(e)))
        own = {}
        for r in by[c]:
            own.setdefault(r.vec_id, []).append(r.whitened)
        some = max(want, key=lambda k: abs(want[k][0]))
        sign = math.copysign(1, want[some][0] * own[some][0])
        for k in want:
            assert sorted(sign * x for x in own[k]) == pytest.approx(sorted(want[k]), abs=1e-6)


def test_query(spark, tmp_path):
    rows = list(enumerate(_rows(200, 20)))
    rows += [(k, rows[0][1]) for k in range(300, 380)]  # a third is one vector
    rows += [(400, None), (401, [None] * 20), (402, [float("nan")] * 20), (403, [1.0] * 19 + [float("inf")]), (404, [1.0]), (None, rows[3][1])]
    kept = [(k, v) for k, v in rows if k != 404]
    spark.createDataFrame([(k, v, "x") for k, v in rows], SCHEMA).write.parquet(f"{tmp_path}/all/embeddings.parquet")
    assert whitening.op13_whitening(spark, f"{tmp_path}/all").count() == 16 * (200 + 80 + 1)
    _check(spark, kept, tmp_path / "kept", 16)


def test_fewer_dimensions_than_components(spark, tmp_path):
    _check(spark, list(enumerate(_rows(60, 3))), tmp_path, 3)


def test_a_tree_of_triangles_equals_one(spark):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in _rows(500, 6)])
    vectors = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(40)
    model = whitening.fit(vectors, 6)
    values, _ = np.linalg.eigh(np.cov(x.T, bias=True))
    assert model.singular**2 / len(x) == pytest.approx(values[::-1], rel=1e-8)
    assert model.sums == x.sum(0).tolist()


def test_degenerate(spark, tmp_path):
    """Nothing usable; one vector; fewer vectors than dimensions; entries beyond 64 bits."""
    cases = {"none": [], "nulls": [(1, None), (2, [None])], "empty": [(1, []), (2, [])], "one": [(1, [1.0, 2.0]), (2, [1.0, 2.0])]}
    cases |= {"flat": [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])], "huge": [(1, [3e38, 0.0]), (2, [-3e38, 1.0])]}
    got = {}
    for name, rows in cases.items():
        spark.createDataFrame([(k, v, "x") for k, v in rows], SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got[name] = sorted(whitening.op13_whitening(spark, f"{tmp_path}/{name}").collect())
    assert not got["none"] and not got["nulls"] and not got["empty"]
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in got["one"]] == [(1, 0, None, None), (2, 0, None, None)] * 2
    assert [(r.component, r.deviation, r.explained) for r in got["flat"]] == [(1, 64 * 64, 1.0), (2, 64 * 64, 0.0), (3, 64 * 64, 0.0)] * 2
    assert [abs(r.whitened) if r.whitened is not None else None for r in got["flat"]] == [pytest.approx(1), None, None] * 2
    assert all(r.deviation is None for r in got["huge"]) and len(got["huge"]) == 4


def test_exact_beyond_doubles(spark):
    x = np.array([[2**40 + 1, 5], [2**40 + 2, 9]], np.int64)
    off = whitening._centred(x, 10**9, [10**20, 3])
    assert off.tolist() == [[10**9 * int(a) - s for a, s in zip(r, [10**20, 3], strict=True)] for r in x]
