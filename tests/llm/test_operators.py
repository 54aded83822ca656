"""Brute-force versions over a small table with nulls, repeats, ties, empty and long texts and clashing columns."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from docsift.llm import decontaminate, gif, induced, language, mixing, quality, simhash, substring_dedup, suffix_dedup, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, label string"


def _rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(120))
    texts = [None, "", "   \n", "one", "!!! ... ,", "one", passage, passage, passage + " tail", "head  " + passage.upper(), "ab " * 400, "x" * 900]
    texts += [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(20)]
    texts += [" ".join(word() for _ in range(3000)) + " " + passage]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), 1, "x", "y") for k, t in enumerate(texts)]
    return [*rows, rows[6], (6, passage + " other", "en", "a", 1, "x", "y"), (None, passage, "en", "a", 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(x):
    return hashlib.sha256(x).hexdigest()


def test_earlier_passages(docs):
    first, want = {}, []
    rows = [(r[0], (r[1] or "").encode().split()) for r in _rows()]
    for i, w in rows:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), _sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    got = substring_dedup.remove_earlier_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_reference_spans(docs, spark):
    got = substring_dedup.remove_reference_spans(docs, docs.filter("doc_id = 6").limit(1))
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id in (7, 8, 3)}
    assert (by_id[7].n_removed, by_id[8].kept_text, by_id[3].n_removed) == (120, "tail", 0)
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, docs, max_words=10)


def test_repeated_bytes(docs):
    rows = [(r[0], (r[1] or "").encode()) for r in _rows()]
    count = Counter(b[k : k + 400] for i, b in rows if i is not None for k in range(len(b) - 399))
    want = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - 399):
            if i is not None and count[b[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, _sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    got = suffix_dedup.remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def _order(text, depth, memory, chunk):
    levels, pos, shared = [], [], []
    for p, s in induced.suffixes(np.array(text, np.uint16), max(text) + 1, depth, memory, chunk, True, levels):
        pos += p.tolist()
        shared += s.tolist()
    return pos[::-1], shared[::-1], levels


def test_suffixes_by_brute_force(monkeypatch):
    r = random.Random(1)
    deepest, spilled = 0, []
    put = induced.Queues.put
    monkeypatch.setattr(induced.Queues, "put", lambda q, c, block: (put(q, c, block), spilled.append(q.spilled))[0])
    for trial in range(60):
        letters, n = r.choice([1, 2, 3, 30]), r.randint(1, 150)
        base = [r.randint(1, letters) for _ in range(n)]
        text = [*base, *base[: r.randint(0, n)], *base, 0]
        depth, memory, chunk = r.choice([400, 7]), r.choice([64, 600, 1 << 20]), r.choice([1, 5, 4096])
        pos, shared, levels = _order(text, depth, memory, chunk)
        deepest = max(deepest, len(levels))
        assert sorted(pos) == list(range(len(text)))
        for k in range(1, len(pos)):
            a, b = text[pos[k - 1] :], text[pos[k] :]
            common = next(i for i, (x, y) in enumerate(zip([*a, -1], [*b, -2], strict=False)) if x != y)
            assert a[:depth] <= b[:depth] and shared[k - 1] == min(common, depth), trial
    assert deepest >= 3 and max(spilled) > 1000


def test_repeats_beyond_memory():
    r = random.Random(1)
    pieces = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 300))) for _ in range(20)]
    count = Counter(p[k : k + 7] for p in pieces for k in range(len(p) - 6))
    want = [[count[p[k : k + 7]] > 1 for k in range(len(p) - 6)] for p in pieces]
    for memory in (256, 4096, 1 << 20):
        assert [list(x) for x in suffix_dedup.repeats(pieces, 7, memory)] == want


def test_queues():
    queue = induced.Queues(16)
    for k in range(4):
        queue.put(1, np.arange(3 * k, 3 * k + 3))
    assert queue.spilled == 96 and queue.take(1, 2).tolist() == [0, 1] and queue.take(1, 4, last=True).tolist() == [8, 9, 10, 11]
    assert queue.take(1, 99).tolist() == list(range(2, 8)) and queue.take(1, 1) is None


def test_simhash(docs):
    prints = []
    for i, t, *_ in _rows():
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    label = {p: min(i for i, q in prints if i is not None and q == p) for i, p in prints if i is not None}
    for _ in range(20):
        for p in label:
            label[p] = min(label[q] for q in label if (p ^ q).bit_count() <= 3)
    got = simhash.near_duplicates(docs).collect()
    want = [(i, p, label[p]) for i, p in prints]
    assert sorted(map(repr, ((r.doc_id, r.bits % 2**64, r.component_id) for r in got))) == sorted(map(repr, want))


def test_gif_round_trip(docs):
    got = gif.read_back(gif.store(docs)).collect()
    want = Counter(_sha(gif.padded((t or "").encode())) for _, t, *_ in _rows())
    assert Counter(r.payload_sha256 for r in got) == want
    two = b"GIF89a\x02\0\x01\0\x80\0\0\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\x09\x05\0\x00\0" + b"\x2c\0\0\0\0\x02\0\x01\0\0\x02"
    stream = gif.lzw_encode(b"\0\x01", 2)
    frames = gif.decode(two + bytes([len(stream)]) + stream + b"\0\x3b")
    assert (frames[0].delay_cs, frames[0].disposal, frames[0].transparent) == (5, 2, 0)
    assert frames[0].canvas[0].tolist() == [[0, 0, 0], [255, 255, 255]]


def test_leaks(docs, spark):
    item = _rows()[6][1]
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "never seen words of a question ? here")], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {6, 7, 8, len(_rows()) - 4, None}  # 9 has other letters than ASCII in upper case
    assert decontaminate.leaks(docs, benchmark, max_tokens=40).count() == decontaminate.leaks(docs, benchmark).count()
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_learners(docs, spark, empty):
    langs, table = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, langs, table).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 4)] == ["und"] * 4 and got[3].lang_pred in langs
    none = language.identify(docs, *language.train(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights = quality.train(quality.train_rows(docs, labels))
    scores = [r.score for r in quality.score(docs, weights).collect()]
    assert len(scores) == len(_rows()) and all(0 <= s <= 1 for s in scores)
    assert {r.score for r in quality.score(docs, quality.train(quality.train_rows(docs, labels.limit(0)))).collect()} == {0.5}


def test_mix(docs):
    import pandas as pd

    documents = pd.DataFrame(_rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(mixing.ORACLE.replace("FROM documents", "FROM (SELECT * REPLACE (CASE WHEN source = 'NaN' THEN NULL ELSE source END AS source) FROM documents)")).fetchall()
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert all(r.taken <= 3 * r.size for r in got)


def test_pages(spark, tmp_path):
    long = "é" * 800
    rows = [(1, "http://A.com/x?y", long), (2, None, long), (3, "no scheme", None), (3, "no scheme", None), (None, "https://www.example.com/en/1", long), (5, "https://b.example.com/en/", "short"), (6, "http://c.org", '<a href="http://b.example.com/q">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and Counter(r.warc_type for r in got) == {"response": 5, "revisit": 2}
    assert {r.refers_to for r in got if r.warc_type == "revisit"} == {"<urn:page:2>"}
    assert warc.read_archive(spark, str(tmp_path / "w"), payload=False).filter("warc_type = 'revisit'").count() == 2
    judged = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert (judged[1].host, judged[1].path, judged[1].rule) == ("a.com", "/x", "com/")
    assert (judged[3].host, judged[3].rule, judged[5].verdict, judged[None].rule) == ("", None, "block", "www.example.com/en/")


def test_foreign_archives(spark, tmp_path):
    """Plain files and gzip members without a length, as other programs write them."""
    import gzip

    records = [warc.record({"WARC-Type": t, "WARC-Record-ID": f"<x:{k}>", "WARC-Target-URI": "http://a/"}, b"p" * k) for k, t in enumerate(["warcinfo", "response", "response", "request"], 5000)]
    for name, data in {"plain": b"".join(records), "zipped": b"".join(map(gzip.compress, records))}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / ("a.warc" if name == "plain" else "a.warc.gz")).write_bytes(data)
        got = warc.read_archive(spark, str(tmp_path / name)).orderBy("content_length").collect()
        assert [(r.warc_type, r.content_length, len(r.payload)) for r in got] == [("warcinfo", 5000, 5000), ("response", 5001, 5001), ("response", 5002, 5002), ("request", 5003, 5003)]
        some = warc.read_archive(spark, str(tmp_path / name), payload=False).filter("warc_type = 'response'").collect()
        assert [(r.record_id, r.payload) for r in some] == [("<x:5001>", None), ("<x:5002>", None)]


def test_mix_seeds(spark):
    docs = spark.createDataFrame([(k if k % 3 else None, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    taken = [sorted(map(repr, mixing.mix(docs, (1, 5), 3, seed).collect())) for seed in ("", "", "other")]
    assert taken[0] == taken[1] != taken[2]


def test_frames():
    """Delays, disposals and colours of a GIF of several frames."""
    block = lambda bits, data: bytes([bits]) + b"".join(bytes([len(x)]) + x for x in [gif.lzw_encode(data, bits)]) + b"\0"
    image = lambda left, data: b"\x2c" + bytes([left, 0, 0, 0, len(data), 0, 1, 0, 0]) + block(2, data)
    control = lambda disposal, delay, clear=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"
    head = b"GIF89a\x03\0\x01\0\x81\0\0" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = head + control(1, 3) + image(0, b"\1\1\1") + control(2, 4, 0) + image(1, b"\2\0") + control(3, 5) + image(0, b"\3") + control(0, 6) + image(2, b"\3") + b"\x3b"
    frames = gif.decode(data)
    canvas = [["".join("kRGB"[[(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)].index(tuple(int(v) for v in p[:3]))] for p in f.canvas[0])] for f in frames]
    assert [f.delay_cs for f in frames] == [3, 4, 5, 6] and [f.disposal for f in frames] == [1, 2, 3, 0]
    # the second frame leaves its transparent pixel; its area is then cleared, the third is undone
    assert canvas[0] == ["RRR"] and canvas[1] == ["RGR"] and canvas[2][0][0] == "B" and canvas[3][0][0] == "R" and canvas[3][0][2] == "B"


def test_empty(empty, spark, tmp_path):
    assert substring_dedup.remove_earlier_passages(empty).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert gif.read_back(gif.store(empty)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages).count() == 0
    warc.archive_pages(pages, str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_frame_rows(spark):
    r = random.Random(7)
    texts = ["".join(chr(r.randrange(32, 127)) for _ in range(n)) for n in (24 * 240 * 2 + 100, 10)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = gif.frames(gif.store(docs)).orderBy("doc_id", "frame").collect()
    assert [(x.doc_id, x.frame, x.start_cs, x.delay_cs, x.width) for x in rows] == [(0, 0, 0, 4, 24), (0, 1, 4, 4, 24), (0, 2, 8, 4, 24), (1, 0, 0, 4, 24), (2, 0, 0, 4, 24)]
    for x, text in ((rows[0], texts[0]), (rows[3], texts[1]), (rows[4], "")):
        shown = gif.padded(text.encode())[: 24 * 240]
        want = Counter((v >> 6) * 21 for v in shown)
        assert {k: n for k, n in enumerate(x.histogram) if n} == want
