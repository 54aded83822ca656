"""Runs against a brute force over all stretches."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from docsift.llm import periodic_runs as op


def _period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[k] == w[k + q] for k in range(len(w) - q)))


def _brute(words, min_exp=4, min_words=6):
    """All maximal stretches by their own definition."""
    n, out = len(words), []
    for a in range(n):
        for b in range(a + min_words, n + 1):
            q = _period(words[a:b])
            if b - a >= min_exp * q and (a == 0 or words[a - 1] != words[a - 1 + q]) and (b == n or words[b] != words[b - q]):
                out.append((a, b - a, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _kept(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def _texts():
    r = random.Random(5)
    out = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "A a A a A a A a", "a b a b a b a b c c c c c c c b c b c b c b", "x y " * 9, "é é é é é é"]
    for k in range(60):
        words = [r.choice("ab" if k % 2 else "abcdef") for _ in range(r.randrange(1, 45))]
        if k % 3 == 0:
            q = r.randrange(1, 6)
            at = r.randrange(len(words))
            words[at:at] = (words[:q] or ["z"]) * r.randrange(3, 8)
        out.append(r.choice([" ", "\n", " \t "]).join(words))
    return out


def _check(got, texts):
    assert len(got) == len(texts)
    for row in got:
        words = (texts[row.doc_id] or "").encode().split()
        words = [w.decode() for w in words]
        runs = _brute(words)
        assert [tuple(x) for x in row.runs] == runs, texts[row.doc_id]
        assert row.collapsed_text == _kept(words, runs)


def test_runs(spark):
    texts = _texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, runs string")
    _check(op.periodic_runs(docs).collect(), texts)
    # every text dealt out by ranges of a few lags
    _check(op.periodic_runs(docs, long=-1, cost=60).collect(), texts)
    _check(op.periodic_runs(docs, long=20, cost=1).collect(), texts)


def test_small_blocks(spark, monkeypatch):
    texts = _texts()
    monkeypatch.setattr(op, "BLOCK", 7)
    import pyarrow as pa

    found = op._scan(pa.array(texts), 4, 6)
    for k, t in enumerate(texts):
        assert [tuple(x) for x in found.get(k, [])] == _brute([w.decode() for w in (t or "").encode().split()])


def test_other_exponents(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in op.periodic_runs(docs, min_exp=2, min_words=3).collect():
        words = [w.decode() for w in (texts[row.doc_id] or "").encode().split()]
        assert [tuple(x) for x in row.runs] == _brute(words, 2, 3)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a a a a a a"), (1, "a a a a a a"), (1, "b"), (None, "c c c c c c c"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for long in (op.LONG, -1):
        got = sorted((str(r.doc_id), r.collapsed_text, len(r.runs)) for r in op.periodic_runs(docs, long=long).collect())
        assert got == [("1", "a", 1), ("1", "a", 1), ("1", "b", 0), ("None", "", 0), ("None", "", 0), ("None", "c", 1)]
        assert op.periodic_runs(docs.limit(0), long=long).count() == 0


def test_a_long_text_is_shared_out(spark):
    r = random.Random(3)
    base = [str(r.randrange(50)) for _ in range(1500)]
    words = [str(r.randrange(1000)) for _ in range(3000)] + base * 5 + ["end"]
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    row = op.periodic_runs(docs, long=1000, cost=1 << 20).collect()[0]
    start = 3000
    while words[start - 1] == words[start + 1499]:
        start -= 1
    assert (start, 10500 - start, 1500) in [tuple(x) for x in row.runs]
    assert row.runs == op.periodic_runs(docs).collect()[0].runs


def test_query(spark, tmp_path):
    texts = _texts() * 4
    docs = spark.createDataFrame([(3 * k - 40, t) for k, t in enumerate(texts)] + [(None, "a a a a a a a a")], "doc_id long, text string")
    docs.withColumn("n_runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1
    planted = 0
    for k, t in [*((3 * k - 40, t) for k, t in enumerate(texts)), (None, "a a a a a a a a")]:
        words = [w.decode() for w in (t or "").encode().split()]
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = _brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert (got[k].n_runs, got[k].start, got[k].length, got[k].period, got[k].exponent_milli) == want
        assert got[k].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got[k].collapsed_sha256 == hashlib.sha256(_kept(words, runs).encode()).hexdigest()
    assert planted > 10
