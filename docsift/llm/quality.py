"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters (ASCII upper case lowered), of digits and of other signs. Features are the hashes of single
tokens, of neighbouring pairs and of a token's shape (class, case and length), each with its share of the text as its
value, so that a score is a sparse dot product that does not depend on length.

The model is fitted in one task on at most ``max_train`` labelled rows, the first by a hash of doc_id; everything else
sees all rows. Defined results: a null or empty text scores the model's bias; without labels all scores are 0.5;
repeated label rows of one doc_id count once, with the lowest label, and of its several texts the one of least hash;
rows without doc_id are scored, never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

BUCKET_BITS = 18
MAX_TRAIN = 8192
EPOCHS = 3
SCALE = 8.0
THRESHOLD = 0.3

_CLASS = np.full(256, 3, np.uint8)
_CLASS[vec.WHITE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows' features, and where each row's begin."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _CLASS[buf]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < n]] = True
    edges = np.append(np.flatnonzero(new), n)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    first = np.searchsorted(starts, off)
    token = vec.word_tokens(vec.LOWER[buf], starts, ends)
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    ups = upper[ends] - upper[starts]
    size = ends - starts
    shape = kind[starts].astype(np.uint64) * np.uint64(64) + np.minimum(size, 15).astype(np.uint64) * np.uint64(4) + ((ups > 0).astype(np.uint64) + (ups == size)) * (kind[starts] == 1)
    pair = token.copy()
    pair[:-1] = vec.mix(token[:-1] * np.uint64(3) + token[1:])
    last = first[1:][first[1:] > first[:-1]] - 1
    pair[last] = vec.mix(token[last] * np.uint64(3))
    every = np.stack([token, pair, vec.mix(shape + np.uint64(0x51AFD7ED))], axis=1).ravel()
    return (every >> np.uint64(64 - bits)).astype(np.int64), first * 3


class Ftrl:
    """Per-coordinate FTRL-proximal learner of a logistic model; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(buckets, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """The first ``max_train`` labelled rows by hash whose crc32(doc_id) mod 5 is not 0: text, label."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def train(rows: DataFrame, bits: int = BUCKET_BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, from at most MAX_TRAIN rows; learnt in one task in the order of a hash of doc_id."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for rows, buf, off in vec.pieces(batch.column("text")):
                at, first = features(buf, off, bits)
                for k in range(len(off) - 1):
                    own, counts = np.unique(at[first[k] : first[k + 1]].astype(np.int32), return_counts=True)
                    held.append((own, (counts * (SCALE / max(1, counts.sum()))).astype(np.float32), int(labels[rows.start + k])))
        model = Ftrl(bits)
        for _ in range(epochs):
            for row in held:
                model.learn(*row)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["at", "w"])

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label").mapInArrow(run, "at long, w double").toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[got["at"].to_numpy(np.int64)] = got["w"].to_numpy()
    return weights


def _scores(weights: np.ndarray, bits: int, column: pa.Array) -> np.ndarray:
    out = []
    for _, buf, off in vec.pieces(column):
        at, first = features(buf, off, bits)
        sums = np.concatenate([[0.0], np.cumsum(weights[at])])
        out.append(weights[-1] + SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first)))
    z = np.concatenate(out) if out else np.zeros(0)
    return np.round(1 / (1 + np.exp(-np.clip(z, -35, 35))), 9)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BUCKET_BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @vec.lean
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(sent.value, bits, batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @vec.lean
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, bits, batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(train_rows(docs, labels)))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
