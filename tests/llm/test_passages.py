"""Repeated passages of words against a brute force over all windows."""

import random

import numpy as np
import pytest

from docsift.llm import suffix_dedup as op


def _brute(rows, window):
    """Text left of each row; the least doc_id that has a window, and its first place there, keep it."""
    holder, seen, out = {}, {}, []
    words = [(d, (t or "").split(" ")) for d, t in rows]
    for d, w in words:
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                holder[key] = min(holder.get(key, d), d)
    for d, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if d is not None and (holder[key] < d or (id(w), key) in seen):
                gone |= set(range(k, k + window))
            seen[id(w), key] = k
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def _rows(seed, window):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.choice([1, 1, 2, 3])))
    shared = [[word() for _ in range(r.randrange(window - 1, 3 * window))] for _ in range(6)]
    rows = []
    for k in range(70):
        out = [word() for _ in range(r.randrange(0, 3 * window))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(out) + 1)
            out[at:at] = r.choice(shared)
        rows.append((k * 3 % 71, " ".join(out)))
    return [*rows, (None, rows[0][1]), (100, ""), (101, None)]


@pytest.mark.parametrize(("window", "gram", "longest"), [(5, 2, None), (9, 4, None), (9, 4, 12)])
def test_passages(spark, monkeypatch, window, gram, longest):
    rows = _rows(window, window)
    want = _brute(rows, window)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if longest:  # longer windows by their digests; here in the same process
        monkeypatch.setattr(op, "LONGEST_WINDOW", longest)
        pieces = [t.encode() for d, t in rows if t and d is not None]
        n, low = [1] * len(pieces), [d for d, t in rows if t and d is not None]
        got = op.least_holders(pieces, n, low, window)
        monkeypatch.setattr(op, "LONGEST_WINDOW", 1 << 14)
        assert all(np.array_equal(a, b) for a, b in zip(got, op.least_holders(pieces, n, low, window), strict=True))
    got = op.remove_repeated_passages(docs, window, gram, shard_bytes=300).collect()
    assert sorted(((r.doc_id, r.kept_text.strip(" ")) for r in got), key=str) == want
    assert any(r.n_removed for r in got)


def test_white_space_and_other_columns(spark):
    passage = " ".join(f"p{k}" for k in range(51))
    rows = [(2, f"a\n{passage}\n\tb  c ", "x"), (1, f"{passage}\nend", "y"), (3, f"{passage} {passage}\n{passage}", "z"), (4, passage[:-3], "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string")
    got = {r.doc_id: r for r in op.remove_repeated_passages(docs, keep=["doc_id", "text", "packed"]).collect()}
    assert {k: v.kept_text for k, v in got.items()} == {2: "a\nb  c ", 1: rows[1][1], 3: "", 4: rows[3][1]}
    assert got[2].row.packed == "x" and got[3].n_words == 153
    assert op.remove_repeated_passages(docs.limit(0)).count() == 0


def test_copies_within_a_document_leave_the_first(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{passage} mid {passage} end"), (2, "other")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in op.remove_repeated_passages(docs).collect()}
    assert got == {1: f"{passage} mid end", 2: "other"}
