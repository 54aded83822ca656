"""Multilingual mixture inference: a document's language proportions by expectation-maximisation.

Each learned language has a smoothed distribution of byte trigrams over words (runs of letters, padded by a space).
A document is a mixture: every word is drawn from one language, by its trigrams' likelihood. For nested language sets,
largest share first, proportions are fitted by expectation-maximisation, and the set with the best likelihood less half
a log(words) for each further language is taken. The language with the largest proportion is predicted.

Trigram counts come from at most ``max_train`` labelled rows, the first by a hash of doc_id. Defined results: ``und``
with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the smaller language name; a row
without doc_id is predicted, never learnt from; repeated rows count each time and get equal predictions; an empty table
gives an empty result; other columns are not read. The set grows, largest share first, as long as that helps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

GRAM_BITS = 16
MAX_TRAIN = 20_000
ROUNDS = 8
SMOOTHING = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_grams(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' trigrams, where each word's begin, and each row's first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    letter = _LETTER[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    sizes = ends - starts
    low = vec.LOWER[buf]
    at = vec.ranges(starts, sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    a = np.full(len(at), 32, np.uint32)
    c = np.full(len(at), 32, np.uint32)
    b = low[at].astype(np.uint32)
    a[1:], c[:-1] = b[:-1], b[1:]
    a[begin[:-1]] = 32
    c[begin[1:] - 1] = 32
    code = (a << 16 | b << 8 | c) * np.uint32(2654435761)
    return (code >> np.uint32(32 - bits)).astype(np.int64), begin, np.searchsorted(starts, off)


def train(docs: DataFrame, bits: int = GRAM_BITS, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log-likelihood of each trigram bucket in each, from rows with a language
    whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("doc_id is not null and lang is not null and text is not null")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows, buf, off in vec.pieces(batch.column("text")):
                grams, begin, first = word_grams(buf, off, bits)
                cut = begin[first]
                for k, lang in enumerate(langs[rows]):
                    sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    sums[lang] += np.bincount(grams[cut[k] : cut[k + 1]], minlength=1 << bits)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "at", "n"])

    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang").mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((1 << bits, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[own["at"].to_numpy(np.int64), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table.astype(np.float32)


def _fit(p: np.ndarray, row: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        r = p * pi[row]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log((p * pi[row]).sum(1) + 1e-30, dtype=np.float64), starts)


def infer(buf: np.ndarray, off: np.ndarray, table: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row's languages (zero without words) and the size of the set taken."""
    rows, k = len(off) - 1, table.shape[1]
    share, taken = np.zeros((rows, k), np.float32), np.zeros(rows, np.int64)
    grams, begin, first = word_grams(buf, off, bits)
    counts = np.diff(first)
    held = np.flatnonzero(counts)
    if not len(held) or not k:
        return share, taken
    like = np.add.reduceat(table[grams], begin[:-1], axis=0)
    p = np.maximum(np.exp(like - like.max(1, keepdims=True)), np.float32(1e-12))
    n = counts[held]
    row, starts = np.repeat(np.arange(len(held)), n), first[held]
    full, _ = _fit(p, row, starts, n, np.full((len(held), k), 1 / k, np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best = np.full(len(held), -np.inf)
    growing = np.ones(len(held), bool)
    for size in range(1, k + 1):
        inside = place < size
        pi = np.where(inside, np.maximum(full, 1e-6), 0).astype(np.float32)
        pi, ll = _fit(p, row, starts, n, pi / pi.sum(1, keepdims=True), rounds if size > 1 else 1)
        ll -= 0.5 * (size - 1) * np.log(n + 1)
        growing &= ll > best
        if not growing.any():
            break
        better = growing
        best[better] = ll[better]
        share[held[better]] = pi[better]
        taken[held[better]] = size
    return share, taken


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, bits: int = GRAM_BITS) -> DataFrame:
    """doc_id, lang_pred, score, n_langs and mixture (language to proportion) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for batch in batches:
            for rows, buf, off in vec.pieces(batch.column("text"), 1 << 20):
                share, taken = infer(buf, off, table, bits)
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
                plain = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                for k in np.flatnonzero(~plain & (taken > 0)):  # only non-ASCII bytes: are there letters?
                    if not any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "ignore")):
                        share[k], taken[k] = 0, 0
                top = share.argmax(1) if len(langs) else np.zeros(len(share), np.int64)
                pred = [langs[t] if n else "und" for t, n in zip(top, taken, strict=True)]
                score = np.round(share.max(1), 6).astype(np.float64) if len(langs) else np.zeros(len(share))
                mixture = [[(langs[j], float(x[j])) for j in np.flatnonzero(x > 0.001)] for x in share]
                yield pa.record_batch(
                    [batch.column("doc_id")[rows], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(taken.astype(np.int32)), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "n_langs", "mixture"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int, mixture map<string, double>")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, *train(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score", "n_langs")
