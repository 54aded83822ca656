"""b-bit MinHash against all pairs of whole sets."""

import random

import numpy as np

from docsift.llm import minhash as op

SCHEMA = "doc_id long, text string, hash string"


def _set(text, size=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _brute(rows, percent=80):
    """Component of each row by row number, None where a set is empty."""
    sets = [_set(t) for _, t in rows]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and label[i] != label[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, (doc, t) in enumerate(rows):
        own = [d for (d, _), x in zip(rows, label, strict=True) if x == label[k] and d is not None]
        out.append((doc, len(sets[k]), min(own, default=None) if sets[k] else doc))
    return sorted(((*x, x[0] == x[2]) for x in out), key=str)


def _texts():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = [None, None, "", "  \n", "One two", "one\tTWO", "one two three", "one two three four", "ONE two Three four", "one two three four one two three four"]
    for k in range(16):
        base = [word() for _ in range(r.choice([9, 12, 60, 200, 900]))]
        out.append(" ".join(base))
        for _ in range(k % 5):  # changed words leave similarities on both sides of 0.8
            own = list(base)
            for _ in range(r.randint(1, max(1, len(own) // 30))):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    line = [word() for _ in range(40)]
    out += [" ".join([*line, *[word() for _ in range(n)]]) for n in (4, 9, 10, 11, 12, 40, 40, 40, 40)]
    base = [word() for _ in range(150)]
    for _ in range(60):  # one large group
        own = list(base)
        own[r.randrange(150)] = word()
        out.append(" ".join(own))
    return out


def _got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=str)


def test_components(spark, monkeypatch):
    rows = list(enumerate(_texts()))
    rows += [(None, rows[10][1]), (None, "only here a b c"), (None, None), (3, "one two three four"), (3, "one two three four"), (-5, rows[-1][1])]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    assert _got(op.near_duplicates(docs)) == _brute(rows)
    # no large group is linked beforehand, and tiles of several salts hold it
    monkeypatch.setattr(op, "GROUP", 9)
    monkeypatch.setattr(op, "best", lambda nodes, pairs, percent: pairs.limit(0))
    assert _got(op.near_duplicates(docs)) == _brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x")], SCHEMA).limit(0)
    assert op.near_duplicates(docs).count() == 0
    assert _got(op.near_duplicates(spark.createDataFrame([(1, None, "x"), (2, "", "x")], SCHEMA))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_follow_the_similarity():
    r = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(30):
            union = r.integers(0, 2**64, 2000, dtype=np.uint64)
            n = int(2000 * share)
            a, b = union[: n + (2000 - n) // 2], np.concatenate([union[:n], union[n + (2000 - n) // 2 :]])
            bits = op.packed(op.minima([a, b]))
            errors.append(float(op.estimate(op.equal(bits[0], bits[1]))) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_equal_counts_lanes():
    r = np.random.default_rng(4)
    low = r.integers(0, 2**64, (50, op.BANDS * op.ROWS), dtype=np.uint64)
    other = np.where(r.random(low.shape) < 0.5, low, r.integers(0, 2**64, low.shape, dtype=np.uint64))
    from docsift.llm import vec

    want = ((vec.mix(low) & np.uint64(15)) == (vec.mix(other) & np.uint64(15))).sum(1)
    assert op.equal(op.packed(low), op.packed(other)).tolist() == want.tolist()


def test_minima_in_chunks(monkeypatch):
    r = np.random.default_rng(5)
    sets = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 5, 40, 3, 17)]
    want = np.array([[(s * a + b).min() for a, b in zip(op._TIMES, op._PLUS, strict=True)] for s in sets])
    for chunk in (3, 8, 1000):
        monkeypatch.setattr(op, "CHUNK", chunk)
        assert (op.minima(sets) == want).all()


def test_the_cut_keeps_pairs_at_the_threshold():
    import math

    least, n = op.least_equal(80), op.BANDS * op.ROWS
    p = 1 / 16 + 15 / 16 * 0.8
    below = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
    assert below <= op.MISS and 0.5 < op.estimate(np.array(least)) < 0.7


def test_pairs_of_large_groups():
    r = random.Random(8)
    label = np.array([r.choice([1, 1, 1, 1, 2, 3]) for _ in range(100)] + [5, 5, 6, 7])
    group = np.array([0] * 100 + [1] * 4)
    side, both = np.array([r.randrange(2) for _ in label]), np.array([1] * 100 + [0] * 4)
    got = sorted(tuple(sorted((int(x), int(y)))) for a, b in op.pairs_of(group, label, side, both) for x, y in zip(a, b, strict=True))
    want = sorted((i, j) for i in range(104) for j in range(i + 1, 104) if group[i] == group[j] and label[i] != label[j] and (not both[i] or side[i] != side[j]))
    assert got == want
