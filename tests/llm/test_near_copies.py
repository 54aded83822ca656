"""Stages of the pipeline against brute force, with null and repeated doc_ids."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _close(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def _groups(texts):
    sets = [_grams(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and _close(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def _texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(30))
    out = [None, "", "  \n", "One two", "one TWO", "one two three"]
    for k in range(12):
        base = [word() for _ in range(r.choice([12, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(k % 4):  # changed words leave similarities on both sides of 0.8
            own = list(base)
            for _ in range(r.randint(1, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [line + " " + " ".join(word() for _ in range(n)) for n in (1, 2, 3, 8, 40, 40, 40, 80, 80, 80, 80, 80)]
    base = [word() for _ in range(150)]
    for _ in range(40):  # one large group
        own = list(base)
        own[r.randrange(150)] = word()
        out.append(" ".join(own))
    return out


def test_near_copies(spark, monkeypatch):
    texts = _texts()
    label = _groups(texts)
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SCHEMA)
    want = sorted({min(k for k, x in enumerate(label) if x == g) for g in label})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    monkeypatch.setattr("docsift.llm.near_copies.GROUP", 7)  # several salts a shingle
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def _odd_rows():
    """Null and repeated doc_ids: copies, unlike texts, equal rows; two of the texts hold the item."""
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item, shared, good, other = text(20), text(100), text(50), text(50)
    texts = [(None, text(40)), (None, text(40) + " " + item), (None, shared), (4, shared + " end"), (4, good), (4, other), (2, other), (7, text(30) + " " + item), (7, text(30)), (9, good), (9, good), (None, None), (None, text(60))]
    return item, [(i, t, "en", "a", k) for k, (i, t) in enumerate(texts)]


def test_odd_doc_ids(spark, tmp_path):
    item, rows = _odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    label, best = _groups([r[1] for r in rows]), {}
    for g, (i, t, *_) in zip(label, rows, strict=True):
        own = (i is None, i or 0, t or "")
        best[g] = min(best.get(g, own), own)
    want = Counter((None if none else i, t or None) for none, i, t in best.values())
    assert sum(want.values()) == len(rows) - 4
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = Counter(r for r in rows if item not in (r[1] or ""))
    assert Counter(map(tuple, corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect())) == clean


def test_quality_keeps_odd_doc_ids(spark):
    from docsift.llm import quality

    docs = spark.createDataFrame(_odd_rows()[1], SCHEMA)
    weights = quality.train(quality.train_rows(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert Counter(map(tuple, quality.keep_good(docs, weights).collect())) == Counter(_odd_rows()[1])
