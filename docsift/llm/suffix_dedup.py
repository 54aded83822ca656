"""Removal of strings of bytes or passages of words that occur more than once in a corpus, by external induced suffix sorting.

Each shard sorts the suffixes of its distinct segments (see segments.py and induced.py): tuples of a suffix and of what it
shares with the one before go through queues on disk, and neighbours in suffix order whose common prefix reaches the window
are repeats. A shard is as large as its anchor makes it; what outgrows ``memory`` is mapped from scratch files.

``remove_repeated_bytes`` removes every copy of a string of bytes. ``remove_repeated_passages`` goes by words and keeps the
first copy: a window of words, written with a blank before each and one after the last, is a string of bytes whose
equals lie side by side in the order of suffixes, whatever its length. The least document of such neighbours keeps it.

Defined results: a null text counts as empty (n_bytes 0); rows with one doc_id are judged apart, each by its own text;
identical rows repeat each other; a row without doc_id is kept whole and is nobody's repeat; texts shorter than the
window keep everything; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced, vec
from .segments import by_anchor, repeated

WINDOW_BYTES = 400
#: Long, so that a line which many documents share is no anchor unless the window around it may be shared too.
ANCHOR_BYTES = 200
#: Bytes of segments that a shard sorts at once.
SHARD_BYTES = 512 << 10
#: Bytes of queues and arrays of a shard that stay in memory.
MEMORY = 8 << 20


def repeats(pieces: list[bytes], window: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each piece, which of its windows also start elsewhere in the pieces."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n = int(sizes.sum()) + len(pieces) + 1
    text = induced.scratch(n, np.uint16, memory)
    for start, piece in zip(starts, pieces, strict=True):  # bytes are 2 to 257, 1 ends a piece, 0 the text
        text[start : start + len(piece)] = np.frombuffer(piece, np.uint8).astype(np.uint16) + 2
        text[start + len(piece)] = 1
    text[n - 1] = 0
    found = induced.scratch(n, bool, memory)
    found[:] = False
    last = 0
    for pos, shared in induced.suffixes(text, 258, window, memory):
        same = shared >= window
        found[pos[same]] = True
        found[np.r_[last, pos[:-1]][same]] = True
        last = pos[-1]
    # a window that goes beyond its piece isn't one
    return [np.array(found[s : s + max(0, w - window + 1)]) for s, w in zip(starts, sizes, strict=True)]


def _runs(flags: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.column_stack([edges[::2], edges[1::2] - edges[::2]]).ravel().astype(np.int32)


def _shard(window: int, limit: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_anchor(batches, ["anchor", "segment", "n", "piece"], "piece", limit):
            pieces, n = shard.column("piece").to_pylist(), shard.column("n").to_pylist()
            spans = [np.array([0, len(x) - window + 1], np.int32) if k > 1 else _runs(flags) for x, k, flags in zip(pieces, n, repeats(pieces, window), strict=True)]
            keep = np.flatnonzero([len(x) > 0 for x in spans])
            yield pa.record_batch([shard.column("anchor").take(pa.array(keep)), shard.column("segment").take(pa.array(keep)), pa.array([spans[k] for k in keep], pa.list_(pa.int32()))], ["anchor", "segment", "spans"])

    return run


def _cut(window: int, whole: list[str]):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in vec.pieces(vec.unpack(batch.column("packed"))):
                hits, bounds = vec.lists(batch.column("hits")[rows])
                row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))[::2]
                begin = hits[::2].astype(np.int64) + off[row]
                marks = np.zeros(len(buf) + 1, np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, begin + hits[1::2] + window - 1, -1)
                gone = np.cumsum(marks[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(buf)]
                first[inner] = gone[inner]
                counts = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
                removed, spans = (c[off[1:]] - c[off[:-1]] for c in counts)
                data, kept = buf.tobytes(), []
                for k in range(len(off) - 1):
                    a, b = off[k], off[k + 1]
                    kept.append(buf[a:b][~gone[a:b]].tobytes() if removed[k] else data[a:b])
                shas, texts = [hashlib.sha256(x).hexdigest() for x in kept], [x.decode("utf-8", "ignore") for x in kept]
                yield pa.record_batch(
                    [*(batch.column(c)[rows] for c in ["doc_id", *whole]), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", *whole, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = ANCHOR_BYTES, shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text: without bytes of strings of ``window`` bytes that
    start elsewhere too. The digest is of all kept bytes; kept_text leaves out cut characters. Columns ``keep``, which
    may have any names, come second as one struct ``row``."""
    got = repeated(docs, "byte", window, gram, apart=False, keep=keep)
    mixed = got.mixed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shard(window, shard_bytes), "anchor long, segment long, spans array<int>")
    # pairs of first window and number of windows; an empty list stands for all windows of a lone segment
    spans = got.alone.filter("n > 1").select("anchor", "segment", F.array().cast("array<int>").alias("spans")).union(mixed)
    own = F.expr("if(size(spans) = 0, array(start, windows), transform(spans, (x, i) -> if(i % 2 = 0, x + start, x)))")
    hits = got.found.join(spans, ["anchor", "segment"]).groupBy(*got.keys).agg(F.flatten(F.collect_list(own)).alias("hits"))
    row = ["row"] if keep else []
    kinds = f"row {got.packed.schema['row'].dataType.simpleString()}, " if keep else ""
    schema = f"doc_id long, {kinds}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return got.packed.join(hits, got.keys, "left").select("doc_id", *row, "packed", "hits").mapInArrow(_cut(window, row), schema)


PASSAGE_WORDS = 51
#: As with bytes, about half a window.
PASSAGE_ANCHOR = 25
#: Bytes of a window that are compared by the suffix sorter; windows of longer words are compared whole.
LONGEST_WINDOW = 1 << 14


def least_holders(pieces: list[bytes], n: list[int], low: list[int], window: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each piece (words joined by blanks, ``n`` times in the corpus, ``low`` the least document) and each of its
    windows the least document that has it; the largest long if the window is there only once."""
    whole = [b" " + x + b" " for x in pieces]
    sizes = np.array([len(x) for x in whole], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    total = int(sizes.sum()) + len(pieces) + 1
    text = induced.scratch(total, np.uint16, memory)
    at, end, owner = [], [], []
    for k, (start, piece) in enumerate(zip(starts, whole, strict=True)):
        raw = np.frombuffer(piece, np.uint8)
        text[start : start + len(piece)] = raw.astype(np.uint16) + 2
        text[start + len(piece)] = 1
        blanks = np.flatnonzero(raw == 32)
        at.append(start + blanks[: max(0, len(blanks) - window)])
        end.append(start + blanks[window:])
        owner.append(np.full(len(at[-1]), k))
    text[total - 1] = 0
    at, end, owner = np.concatenate(at), np.concatenate(end), np.concatenate(owner)
    need = end - at + 1
    least = np.full(len(at), np.iinfo(np.int64).max)
    if not len(at):
        return [least for _ in pieces]
    times, lows = np.array(n, np.int64)[owner], np.array(low, np.int64)[owner]

    def joined(members: np.ndarray, new: np.ndarray) -> None:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(members)))
        often = np.add.reduceat(times[members], begin) > 1
        least[members] = np.where(np.repeat(often, size), np.repeat(np.minimum.reduceat(lows[members], begin), size), np.iinfo(np.int64).max)

    short = need <= LONGEST_WINDOW
    if short.any():
        number = induced.scratch(total, np.int64, memory)
        number[:] = -1
        number[at[short]] = np.flatnonzero(short)
        order, fresh = [], []
        for pos, shared in induced.suffixes(text, 258, int(need[short].max()), memory):
            own = np.asarray(number[pos])
            here = own >= 0
            order.append(own[here])
            fresh.append(shared[here] < need[own[here]])
        order, fresh = np.concatenate(order), np.concatenate(fresh)
        fresh[0] = True
        joined(order, fresh)
    if not short.all():
        rest = np.flatnonzero(~short)
        data = b"".join(x + b"\n" for x in whole)  # as many bytes as the text has symbols before its end
        keys = np.array([hashlib.sha256(data[at[k] : end[k] + 1]).digest() for k in rest])
        order = np.argsort(keys, kind="stable")
        joined(rest[order], np.r_[True, keys[order][1:] != keys[order][:-1]])
    return np.split(least, np.cumsum(np.bincount(owner, minlength=len(pieces)))[:-1])


def _holders(window: int, limit: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_anchor(batches, ["anchor", "segment", "low", "n", "piece"], "piece", limit):
            least = least_holders(*(shard.column(c).to_pylist() for c in ("piece", "n", "low")), window)
            yield pa.record_batch([shard.column("anchor"), shard.column("segment"), pa.array(least, pa.list_(pa.int64()))], ["anchor", "segment", "least"])

    return run


def _cut_words(window: int, whole: list[str]):
    """Words of windows that others hold (``hits`` from 0 on), and of those of the document's own (-1 - start) that it has
    had before, go with the white space after them."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in vec.pieces(vec.unpack(batch.column("packed"))):
                starts, ends, first = vec.words(buf, off)
                roll = vec.Rolling(vec.word_tokens(buf, starts, ends))
                hits, bounds = vec.lists(batch.column("hits")[rows])
                hits = hits.astype(np.int64)
                row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
                own = hits < 0
                again, of = (-1 - hits[own]) + first[row[own]], row[own]
                key = vec.mix(roll.spans(again, again + window))
                order = np.lexsort((again, key, of))
                again, key, of = again[order], key[order], of[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(order) else order
                # equal rows of one doc_id each bring the first place along
                later = again != np.repeat(again[new], np.diff(np.append(new, len(order))))
                gone = vec.covered(np.concatenate([hits[~own] + first[row[~own]], again[later]]), window, len(starts))
                until = np.append(starts[1:], len(buf))
                last = first[1:][first[1:] > first[:-1]] - 1
                until[last] = off[1:][first[1:] > first[:-1]]
                marks = np.zeros(len(buf) + 1, np.int32)
                np.add.at(marks, starts[gone], 1)
                np.add.at(marks, until[gone], -1)
                keep = np.cumsum(marks[:-1]) == 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                kept = [buf[a:b][keep[a:b]].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)]
                columns = [*(batch.column(c)[rows] for c in ["doc_id", *whole]), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(kept, pa.string())]
                yield pa.record_batch(columns, ["doc_id", *whole, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated_passages(docs: DataFrame, window: int = PASSAGE_WORDS, gram: int = PASSAGE_ANCHOR, shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: without words of windows that start in a smaller doc_id or earlier in the same
    document, so that one copy of everything stays. White space elsewhere is kept. Rows with one doc_id are one document for
    the order, and what they share stays; columns ``keep`` come second as one struct ``row``."""
    got = repeated(docs, "word", window, gram, apart=False, keep=keep)
    mixed = got.mixed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_holders(window, shard_bytes), "anchor long, segment long, least array<bigint>")
    # one value serves all windows of a lone segment
    least = got.alone.filter("n > 1").select("anchor", "segment", F.array("low").alias("least")).union(mixed)
    hit = "CASE WHEN least[if(size(least) = 1, 0, i)] < doc_id THEN start + i WHEN least[if(size(least) = 1, 0, i)] = doc_id THEN -1 - start - i END"
    starts = F.expr(f"filter(transform(sequence(0, windows - 1), i -> {hit}), x -> x IS NOT NULL)")
    hits = got.found.join(least, ["anchor", "segment"]).select(*got.keys, starts.alias("hits")).filter(F.size("hits") > 0)
    hits = hits.groupBy(*got.keys).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    row = ["row"] if keep else []
    kinds = f"row {got.packed.schema['row'].dataType.simpleString()}, " if keep else ""
    return got.packed.join(hits, got.keys, "left").select("doc_id", *row, "packed", "hits").mapInArrow(_cut_words(window, row), f"doc_id long, {kinds}n_words long, n_removed long, kept_text string")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
