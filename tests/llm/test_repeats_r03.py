"""Checks of round 3 that repeated windows failed: the time of op6 and the disk of the pipeline's suffix stage."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from docsift.llm import induced, suffix_dedup
from docsift.llm.segments import repeated


class _Counted(np.ndarray):
    """Counts the symbols that are looked at."""

    seen = 0

    def __getitem__(self, key):
        got = np.asarray(self).__getitem__(key)
        _Counted.seen += np.size(got)
        return got


def _plain(text, a, b, most):
    out = 0
    while out < most and max(a, b) + out < len(text) and text[a + out] == text[b + out]:
        out += 1
    return out


def test_long_common_prefixes_are_compared_once():
    """op6_suffix_array_dedup: 964 CPU seconds a GB, most of them prefixes of 400 bytes from every place of a repeat."""
    r = np.random.default_rng(5)
    passage = r.integers(2, 250, 3000)
    text = np.concatenate([passage, [300], passage, [301, 0]]).astype(np.uint16)
    a = np.arange(0, 2600, 3)
    b, most = a + len(passage) + 1, np.full(len(a), 400)
    _Counted.seen = 0
    got = induced.shared_prefix(text.view(_Counted), a, b, most)
    assert (got == np.minimum(400, len(passage) - a)).all()
    assert _Counted.seen < 2 * (24 * len(a) + len(passage) + 500)


@pytest.mark.parametrize(("near", "chunk"), [(24, 1 << 16), (1, 50)])
def test_shared_prefixes_against_plain_comparison(monkeypatch, near, chunk):
    monkeypatch.setattr(induced, "_NEAR", near)
    monkeypatch.setattr(induced, "CHUNK", chunk)
    r = random.Random(near)
    for _ in range(60):
        size, period = r.randrange(2, 300), r.randrange(1, 90)
        base = [r.choice([1, 2, r.randrange(1, 200)]) for _ in range(period)]
        text = [base[k % period] if r.random() < 0.99 else r.randrange(1, 5) for k in range(size)] + [0]
        a = [r.randrange(size) for _ in range(80)]
        b = [min(size, max(0, x + r.choice([-period, period, r.randrange(-size, size)]))) for x in a]
        a, b = map(list, zip(*[(x, y) for x, y in zip(a, b, strict=True) if x != y] or [(0, 1)], strict=True))
        most = [r.choice([3, 60, 200]) for _ in a]
        got = induced.shared_prefix(np.array(text, np.uint16), np.array(a), np.array(b), np.array(most))
        assert got.tolist() == [_plain(text, *x) for x in zip(a, b, most, strict=True)]


def _docs(spark):
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(k, f"own {k} {passage} end {k}", "en", "web", 1) for k in range(30)] + [(99, None, None, None, None)]
    return passage, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_segments_at_repeated_anchors_are_found_once(spark):
    """op6_suffix_array_dedup, op1, the pipeline: anchors were sought and segments made anew for each use of them."""
    got = repeated(_docs(spark)[1], "word", 51, 25, apart=False)
    assert got.found.count() and "MapInArrow" not in got.found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_shuffled_once_and_packed_only(spark, monkeypatch):
    """pipeline, suffix_array_dedup: 4.1 x the input of disk; rows took their texts along, beside the packed ones, and with
    other columns than the step before, so that both were shuffled."""
    passage, docs = _docs(spark)
    asked, real = [], suffix_dedup.remove_repeated_passages
    monkeypatch.setattr(suffix_dedup, "remove_repeated_passages", lambda *a, keep, **k: asked.append(keep) or real(*a, keep=keep, **k))
    out = pipeline.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == f"own 0 {passage} end 0" and got[7].text == "own 7 7" and got[99].text == ""
    assert (got[7].lang, got[7].source, got[7].n_chars, got[99].n_chars) == ("en", "web", 7, 0)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(doc_id" in x and "REPARTITION_BY_COL" in x]
    assert len(moved) == 2 and sum("ReusedExchange" in x for x in moved) == 1
    assert asked == [["doc_id", "lang", "source"]]
