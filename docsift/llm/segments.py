"""Repeated windows of tokens, found exactly and without pairing documents.

A window is ``window`` consecutive tokens (words or bytes) of one document. Its anchor is the least-hashed run of
``gram`` tokens in it, the first of equals, so that equal windows have equal anchors wherever they stand.
Consecutive windows that share one anchor position form a segment. Three shuffles follow:

1. (anchor, document) pairs meet by anchor, packed; an anchor that one document alone has can't hold a repeat.
2. Documents that hold repeated anchors give the hashes of those segments; equal segments become one row
   (with their number and smallest document), before anything else moves.
3. Where an anchor has several distinct segments, their texts, each from one document, meet in one shard, where an
   exact structure (the caller's) compares them.

What shards find goes back to the documents by segment. No step collects a document's partners; there is an anchor for
about every (window - gram) / 2 tokens. Documents are shuffled once, each text compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .shared import persisted


class Tokens:
    """Tokens of a piece: words (changing nothing in them) or bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, unit: str):
        self.buf, self.unit = buf, unit
        if unit == "word":
            self.starts, self.ends, self.first = vec.words(buf, off)
            self.hashes = vec.word_tokens(buf, self.starts, self.ends)
        else:
            self.first, self.hashes = off, vec.byte_tokens(buf)
        self.roll = vec.Rolling(self.hashes)

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """Bytes of token spans; words are joined by one space."""
        if self.unit == "byte":
            return vec.binaries(self.buf, start, end)
        sizes = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.full(int(at[-1]), 32, np.uint8)
        joined[vec.ranges(at[:-1], sizes - 1)] = self.buf[vec.ranges(self.starts, sizes - 1)]
        return vec.binaries(joined, at[start], at[end] - 1)

    def segments(self, window: int, gram: int) -> dict[str, np.ndarray]:
        """row, first window, number of windows, anchor and hash of each segment."""
        n, none = len(self.hashes), np.zeros(0, np.int64)
        if n < window:
            return {"row": none, "start": none, "windows": none, "anchor": none.view(np.uint64), "segment": none.view(np.uint64)}
        grams = vec.mix(self.roll.grams(gram))
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        at = (vec.sliding_min(keys, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        counts = np.maximum(np.diff(self.first) - window + 1, 0)
        inside = vec.ranges(self.first[:-1], counts)
        row = np.repeat(np.arange(len(counts)), counts)
        at = at[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(row) != 0)
        begin = np.flatnonzero(new)
        windows = np.diff(np.append(begin, len(inside)))
        start = inside[begin]
        anchor = grams[at[begin]]
        whole = vec.mix(self.roll.spans(start, start + windows + window - 1) + windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return {"row": row[begin], "start": start, "windows": windows, "anchor": anchor, "segment": whole}


def _blob(columns: list[np.ndarray], rows: np.ndarray) -> bytes:
    """Longs of some rows, column by column and, within a column, byte plane by byte plane, which shuffles well."""
    return b"".join(np.ascontiguousarray(c[rows]).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unblob(blob: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _anchors(unit: str, window: int, gram: int, keys: list[str]) -> Callable:
    """Columns of a piece's pairs of an anchor and its document's keys."""

    def find(batch: pa.RecordBatch, rows: slice, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        got = Tokens(buf, off, unit).segments(window, gram)
        return [got["anchor"].view(np.int64), *(batch.column(k)[rows].to_numpy()[got["row"]] for k in keys)]

    return find


def ask(find: Callable, apart: bool, buckets: int) -> Callable:
    """Rows (bucket, known, pairs): pairs of an anchor and a document that ask the anchor's bucket whether it repeats.
    ``find`` gives the pairs of a piece, as columns of longs: the anchor and one or more keys of the document.

    An anchor that repeats within the piece is known to: two of its pairs still go to its bucket, for the others to
    learn of it, and all of them to a bucket of the piece, so that a frequent anchor's pairs do not gather.
    """

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in vec.pieces(batch.column("text")):
                columns = find(batch, rows, buf, off)
                if not len(columns[0]):
                    continue
                order = np.lexsort((columns[1], columns[0]))
                columns = [c[order] for c in columns]
                new = np.r_[True, columns[0][1:] != columns[0][:-1]]
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(new)) - 1
                several = columns[1][begin] != columns[1][end] if apart else end > begin
                known = np.repeat(several, end - begin + 1)
                lone = ~known
                if apart and len(columns) == 2:  # one pair stands for all of a document's
                    lone &= new
                lone[begin[several]] = True
                lone[end[several]] = True
                ask = np.flatnonzero(lone)
                bucket = (columns[0][ask].view(np.uint64) >> np.uint64(20)).astype(np.int64) % buckets
                ask = ask[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                blobs = [_blob(columns, ask[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                at, is_known = bucket[cuts[:-1]].tolist(), [False] * len(blobs)
                if known.any():
                    blobs.append(_blob(columns, np.flatnonzero(known)))
                    at.append(int(columns[0][0]) % buckets)
                    is_known.append(True)
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(is_known), pa.array(blobs, pa.binary())], ["bucket", "known", "pairs"])

    return run


def answer(keys: list[str], apart: bool, buckets: int) -> Callable:
    """Rows (home, pairs): the pairs of repeated anchors, packed by a bucket of their documents."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = [], []
        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                (found if known else asked).append(_unblob(blob, 1 + len(keys)))
        if asked:
            pairs = np.concatenate(asked, axis=1)
            asked.clear()
            pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
            begin = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]])
            end = np.append(begin[1:], pairs.shape[1]) - 1
            several = pairs[1, begin] != pairs[1, end] if apart else end > begin
            found.append(pairs[:, np.repeat(several, end - begin + 1)])
        pairs = np.concatenate(found, axis=1) if found else np.zeros((1 + len(keys), 0), np.int64)
        if pairs.shape[1]:
            home = (vec.mix(pairs[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pairs[1], home))
            home, columns = home[order], list(pairs[:, order])
            cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True])
            blobs = [_blob(columns, np.arange(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(home[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["home", "pairs"])

    return run


def unpack(keys: list[str]) -> Callable:
    """Rows (keys, wanted): each document's repeated anchors; rows must come sorted by home."""

    def documents(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([_unblob(x, 1 + len(keys)) for x in blobs], axis=1)
        pairs = pairs[:, np.lexsort(pairs[1:][::-1])]
        cuts = np.flatnonzero(np.r_[True, (pairs[1:, 1:] != pairs[1:, :-1]).any(axis=0), True])
        own = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(pairs[0]))
        yield pa.record_batch([*(pa.array(c[cuts[:-1]]) for c in pairs[1:]), own], [*keys, "wanted"])

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if home != at and held:
                    yield from documents(held)
                    held = []
                at = home
                held.append(blob)
        if held:
            yield from documents(held)

    return run


def _segments(unit: str, window: int, gram: int, keys: list[str], by: str, with_text: bool) -> Callable:
    """Segments whose anchor (or own hash, as ``by`` says) is in the row's list ``wanted``."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("wanted").is_valid())
            for rows, buf, off in vec.pieces(vec.unpack(batch.column("packed"))):
                tokens = Tokens(buf, off, unit)
                got = tokens.segments(window, gram)
                values, bounds = vec.lists(batch.column("wanted")[rows])
                # hashes are looked up with their row
                salt = vec.mix(np.arange(1, len(off), dtype=np.uint64))
                wanted = vec.mix(values.view(np.uint64) ^ np.repeat(salt, np.diff(bounds)))
                own = vec.mix(got[by] ^ salt[got["row"]])
                keep = np.flatnonzero(np.isin(own, wanted))
                if with_text:
                    keep = keep[np.unique(own[keep], return_index=True)[1]]
                got = {k: v[keep] for k, v in got.items()}
                take = pa.array(got["row"])
                out = {"anchor": vec.longs(got["anchor"]), "segment": vec.longs(got["segment"])}
                if with_text:
                    out["piece"] = tokens.texts(got["start"], got["start"] + got["windows"] + window - 1)
                else:
                    out |= {k: batch.column(k)[rows].take(take) for k in keys}
                    out["start"] = pa.array((got["start"] - tokens.first[got["row"]]).astype(np.int32))
                    out["windows"] = pa.array(got["windows"].astype(np.int32))
                yield pa.record_batch(list(out.values()), list(out))

    return run


@vec.lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [vec.pack(batch.column(c)) if c == "text" else batch.column(c) for c in batch.schema.names]
        yield pa.record_batch(cols, ["packed" if c == "text" else c for c in batch.schema.names])


@dataclass
class Repeats:
    """What the shuffles of this module give.

    packed: the documents (keys, packed text, and the whole row if it is kept), shuffled by keys
    keys: doc_id, and text_key (a hash of the text) where a doc_id repeats
    found: anchor, segment, keys, start, windows of every segment at a repeated anchor
    mixed: anchor, segment, low, piece of the distinct segments of anchors that have several
    alone: anchor, segment, low, n of the distinct segments that are their anchor's only one
    """

    packed: DataFrame
    keys: list[str]
    found: DataFrame
    mixed: DataFrame
    alone: DataFrame


def repeated(docs: DataFrame, unit: str, window: int, gram: int, apart: bool, keep: list[str] | None = None) -> Repeats:
    """``apart``: only windows of different doc_ids count as repeats. ``keep``: columns that go along in the struct
    ``row``, under their own names, so that none can clash with a column of this module.

    Segments at repeated anchors are found once and kept, so that the steps before them don't run for each use. The packed
    documents are joined from the left each time, by the same keys and with ``row``, so that one shuffle serves what follows.
    """
    doc_id = F.col("doc_id").cast("long")
    again = docs.select(doc_id.alias("doc_id")).groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count()
    keys = ["doc_id", "text_key"] if again else ["doc_id"]
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    source = docs.select(doc_id.alias("doc_id"), "text", *row, *([F.xxhash64("text").alias("text_key")] if again else []))
    key_kinds = ", ".join(f"{k} long" for k in keys)
    kinds = f", row {source.schema['row'].dataType.simpleString()}" if keep else ""
    packed = source.select(*keys, "text", *(["row"] if keep else [])).mapInArrow(_pack, f"{key_kinds}, packed binary{kinds}").repartition(*keys)
    buckets = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = source.filter(F.col("doc_id").isNotNull()).select(*keys, "text").mapInArrow(ask(_anchors(unit, window, gram, keys), apart, buckets), "bucket int, known boolean, pairs binary")
    held = asked.repartition("bucket").select("known", "pairs").mapInArrow(answer(keys, apart, buckets // 4), "home int, pairs binary")
    held = held.repartition("home").sortWithinPartitions("home").mapInArrow(unpack(keys), f"{key_kinds}, wanted array<bigint>")

    def of(wanted: DataFrame, by: str, with_text: bool) -> DataFrame:
        joined = packed.join(wanted, keys, "left").select(*keys, "packed", "wanted", *(["row"] if keep and with_text else []))
        schema = "anchor long, segment long, " + ("piece binary" if with_text else f"{key_kinds}, start int, windows int")
        return joined.mapInArrow(_segments(unit, window, gram, keys, by, with_text), schema)

    found = persisted(of(held, "anchor", False))
    first = F.min("doc_id") if len(keys) == 1 else F.min(F.struct(*keys))
    distinct = found.groupBy("anchor", "segment").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    low = F.col("first") if len(keys) == 1 else F.col("first.doc_id")
    counted = persisted(distinct.repartition("anchor").withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("anchor")) > 1))
    alone = counted.filter(~F.col("several")).select("anchor", "segment", low.alias("low"), "n")
    several = counted.filter("several").select("anchor", "segment", "first", low.alias("low"), "n")
    # their texts, each from the first document that has it
    at = [F.col("first").alias("doc_id")] if len(keys) == 1 else [F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")]
    texts = of(several.select("segment", *at).groupBy(*keys).agg(F.collect_set("segment").alias("wanted")), "segment", True)
    mixed = several.drop("first").join(texts, ["anchor", "segment"])
    return Repeats(packed, keys, found, mixed, alone)


def by_anchor(batches: Iterator[pa.RecordBatch], columns: list[str], size: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Whole anchors, gathered until ``size`` bytes of a column pass ``limit``; rows must come sorted by anchor."""
    held: list[pa.RecordBatch] = []
    total = 0
    for whole in batches:
        whole = whole.select(columns)
        step = max(1, int(whole.num_rows * limit / (2 * max(1, whole.column(size).nbytes))))
        for k in range(0, whole.num_rows, step):
            batch = whole.slice(k, step)
            if held and total > limit:
                same = batch.column("anchor").to_numpy() == held[-1].column("anchor")[-1].as_py()
                n = len(same) if same.all() else int(np.argmin(same))
                held.append(batch.slice(0, n))
                if n == len(same):
                    continue
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total, batch = [], 0, batch.slice(n)
            held.append(batch)
            total += batch.column(size).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
