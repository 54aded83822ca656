"""Periodic runs of words: an all-lag scan that compares the words of a text with the same words, shifted by each lag.

Two words ``q`` apart that are equal make a true entry at lag ``q``; a stretch of ``t`` true entries is a run of ``t + q``
words with period ``q``. A run has ``min_exp`` times its period in words, so lags up to n / min_exp are all there are.
Texts of a batch are laid back to back, longest first, as word ids that no two texts share: at each lag the texts that are
long enough are one array, compared at once. Stretches are run-length encoded where enough evenly spaced entries in a
row are true; every stretch that is long enough has such a row.

By Fine and Wilf's theorem a stretch with a smaller period has one that divides the lag, and the same words are then a
run at that smaller lag; so of equal stretches the one of least lag is the run.

The scan costs n * n / (2 * min_exp) comparisons. Texts of over ``LONG`` characters are therefore dealt out as ranges of
lags of about COST comparisons each, so that machines share one long text; its ranges meet again as runs, not words. Shorter texts
are scanned where they are read, and no text of them is shuffled.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; rows with one doc_id,
without doc_id or with equal texts each give a row; words are compared by bytes (by 64-bit hashes within a text), so case
counts; other columns are not read; an empty table gives an empty result; very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

MIN_EXP, MIN_WORDS = 4, 6
#: Characters of a text that is dealt out by ranges of lags, and comparisons of such a range.
LONG, COST = 1 << 16, 1 << 26
#: Words compared at once.
BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def stretches(ids: np.ndarray, first: np.ndarray, low: int, high: int, min_exp: int, min_words: int) -> np.ndarray:
    """Columns (row, start, length, lag) of the stretches of lags from ``low`` to before ``high`` that are long enough.

    ``ids`` are those of texts back to back, longest first, none in two texts; ``first`` has their boundaries."""
    sizes = np.diff(first)
    found = [np.zeros((0, 4), np.int64)]
    same = np.zeros(len(ids), bool)
    for lag in range(low, min(high, int(sizes[0]) // min_exp + 1) if len(sizes) else low):
        rows = int(np.searchsorted(-sizes, -min_exp * lag, "right"))
        n = int(first[rows]) - lag
        hit = np.equal(ids[:n], ids[lag : lag + n], out=same[:n])
        need = max(min_words - lag, (min_exp - 1) * lag)
        step = max(1, need // 4)
        some, times = hit[::step], need // step
        m = len(some) - times + 1
        if m <= 0:
            continue
        row = some[:m] & some[1 : m + 1] if times > 1 else some[:m]
        for k in range(2, times):
            row &= some[k : m + k]
        at = np.flatnonzero(row)
        if not len(at):
            continue
        # only texts with such entries are looked at closely
        for k in np.unique(np.searchsorted(first, at * step, "right") - 1).tolist():
            a = int(first[k])
            edges = np.flatnonzero(np.diff(hit[a : min(int(first[k + 1]), n)].view(np.int8), prepend=0, append=0))
            begin, end = edges[::2], edges[1::2]
            enough = end - begin >= need
            begin, end = begin[enough], end[enough]
            found.append(np.stack([np.full(len(begin), k), begin, end - begin + lag, np.full(len(begin), lag)], 1))
    return np.concatenate(found)


def least_lags(found: np.ndarray) -> np.ndarray:
    """Of equal stretches the one of least lag, in order of row, start and period."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, word ids and boundaries of about BLOCK words of texts, longest first."""
    buf, off = vec.utf8(column)
    sizes = []
    hashes = []
    for rows, part, bounds in vec.pieces(column):
        starts, ends, first = vec.words(part, bounds)
        row = np.repeat(np.arange(rows.start, rows.stop), np.diff(first))
        hashes.append(vec.mix(vec.word_tokens(part, starts, ends) ^ vec.mix(row.astype(np.uint64) + np.uint64(1))))
        sizes.append(np.diff(first))
    if not sizes:
        return
    size, tokens = np.concatenate(sizes), np.concatenate(hashes)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        total = np.cumsum(size[order[at:]])
        n = max(1, int(np.searchsorted(total, BLOCK, "right")))
        own = order[at : at + n]
        ids = np.unique(tokens[vec.ranges(start[own], size[own])], return_inverse=True)[1].astype(np.int32)
        yield own, ids, np.concatenate([[0], np.cumsum(size[own])])
        at += n


def _scan(column: pa.Array, min_exp: int, min_words: int) -> dict[int, np.ndarray]:
    """Runs (start, length, period) of each row that has any."""
    out = {}
    for own, ids, first in _blocks(column):
        found = least_lags(stretches(ids, first, 1, len(ids), min_exp, min_words))
        cuts = np.flatnonzero(np.diff(found[:, 0])) + 1
        for part in np.split(found, cuts):
            if len(part):
                out[int(own[part[0, 0]])] = part[:, 1:]
    return out


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """Words of a text without those after the first period of a run, joined by one space."""
    words = text.split()  # at space and 9 to 13
    if not len(runs):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, k in zip(words, (np.cumsum(marks[:-1]) == 0).tolist(), strict=True) if k])


def _result(ids: pa.Array, column: pa.Array, runs: dict[int, np.ndarray]) -> pa.RecordBatch:
    none = np.zeros((0, 3), np.int64)
    own = [runs.get(k, none) for k in range(len(column))]
    flat = np.concatenate([none, *own])
    structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["start", "length", "period"])
    bounds = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
    texts = [collapsed(t.encode() if t is not None else b"", r).decode() for t, r in zip(column.to_pylist(), own, strict=True)]
    return pa.record_batch([ids, pa.ListArray.from_arrays(bounds, structs), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed_text"])


def _whole(min_exp: int, min_words: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch.column("doc_id"), batch.column("text"), _scan(batch.column("text"), min_exp, min_words))

    return run


def _ranged(min_exp: int, min_words: int):
    """Stretches of one range of lags of each row."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for _, ids, first in _blocks(batch.column("text").slice(k, 1)):
                    low, high = batch.column("low")[k].as_py(), batch.column("high")[k].as_py()
                    found = stretches(ids, first, low, high, min_exp, min_words)
                    yield pa.record_batch([pa.array([batch.column("digest")[k].as_py()] * len(found), pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in found[:, 1:].T)], ["digest", "start", "length", "period"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = {}
        for k, own in enumerate(batch.column("found").to_pylist()):
            if own:
                runs[k] = least_lags(np.array([(0, x["start"], x["length"], x["period"]) for x in own], np.int64))[:, 1:]
        yield _result(batch.column("doc_id"), batch.column("text"), runs)


def periodic_runs(docs: DataFrame, min_exp: int = MIN_EXP, min_words: int = MIN_WORDS, long: int = LONG, cost: int = COST) -> DataFrame:
    """doc_id, runs (start, length and period of each, by start, then period), collapsed_text of each of (doc_id, text)."""
    if min_exp < 2 or min_words < 2:
        raise ValueError("a run has two periods and two words at least")
    # what isn't deterministic keeps the condition on lengths from being moved below the making of a text, which would be made anew for it
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) + F.least("row", F.lit(0)) > long
    schema = f"doc_id long, runs {RUNS}, collapsed_text string"
    short = docs.filter(~is_long).select("doc_id", "text").mapInArrow(_whole(min_exp, min_words), schema)
    marked = docs.filter(is_long).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    texts = marked.select("digest", "text").dropDuplicates(["digest"]).withColumn("n", F.regexp_count("text", F.lit(WORD)).cast("long"))
    step = F.greatest(F.lit(1), F.floor(F.lit(cost) / F.col("n"))).cast("long")
    lags = F.floor(F.col("n") / min_exp).cast("long")
    ranges = texts.withColumn("step", step).filter(lags > 0).withColumn("low", F.explode(F.sequence(F.lit(1), lags, F.col("step"))))
    ranges = ranges.select("digest", "text", "low", (F.col("low") + F.col("step")).alias("high")).repartition("digest", "low")
    found = ranges.mapInArrow(_ranged(min_exp, min_words), "digest string, start long, length long, period long")
    found = found.groupBy("digest").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    rest = marked.join(found, "digest", "left").select("doc_id", "text", "found").mapInArrow(_joined, schema)
    return short.unionByName(rest)


def digests() -> list[Column]:
    """n_runs, the longest run and the hashes of what periodic_runs gives."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    start, length, period = -best["start"], best["length"], -best["period"]
    return [
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    ]


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every document whose h = crc32(decimal doc_id) ends in 0, the words from a = g % n on repeat with
    period 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10). Rows without doc_id keep their texts."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    known = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    known = known.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # no lambda over the words, as the optimizer may cut them out anew for each of them
    part = "flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast((n - a + p - 1) div p as int)))"
    again = F.expr(f"array_join(concat(slice(words, 1, cast(a as int)), slice({part}, 1, cast(n - a as int))), ' ')")
    return known.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return periodic_runs(docs).select("doc_id", *digests())
