"""Removal of passages of words that an earlier document has, by suffix automata.

``remove_reference_spans`` streams documents through automata of a reference of bounded size, which is broadcast.
``remove_earlier_passages`` judges a corpus against itself. Its automata together are as large as the corpus, so they
are not broadcast: each shard builds the automaton of the distinct segments of its anchors (see segments.py), streams
those segments through it for matching statistics, and the spans found return to the documents.

Defined results: a null text counts as empty; a row without doc_id keeps all its words and is nobody's source; rows
with one doc_id are one document for the order, each judged by its own text; texts shorter than a window keep
everything; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .segments import by_anchor, repeated

WINDOW_WORDS = 13
ANCHOR_WORDS = 6
#: Bytes of segments in one shard's automaton.
SHARD_BYTES = 512 << 10
#: Words of a reference that may be broadcast.
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Of several token sequences; a state holds the substrings that end at the same places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c, q: int) -> int:
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            state = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = state
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = state

    def statistics(self, sequence, window: int) -> Iterator[tuple[int, int]]:
        """For each token, the length of the longest suffix so far that the automaton has (cut to those that
        still hold ``window`` tokens) and its state, which identifies the window that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            yield matched, state


def _shard(window: int, limit: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_anchor(batches, ["anchor", "segment", "low", "piece"], "piece", limit):
            lows = shard.column("low").to_pylist()
            texts = [x.split(b" ") for x in shard.column("piece").to_pylist()]
            automaton = SuffixAutomaton()
            for text in texts:
                automaton.add(text)
            first: dict[int, int] = {}
            ends = []
            for text, low in zip(texts, lows, strict=True):
                ends.append([state for matched, state in automaton.statistics(text, window) if matched >= window])
                for state in ends[-1]:
                    if first.get(state, low) >= low:
                        first[state] = low
            least = [[first[s] for s in own] for own in ends]
            yield pa.record_batch([shard.column("anchor"), shard.column("segment"), pa.array(least, pa.list_(pa.int64()))], ["anchor", "segment", "least"])

    return run


def _cut(window: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in vec.pieces(vec.unpack(batch.column("packed"))):
                starts, ends, first = vec.words(buf, off)
                hits, bounds = vec.lists(batch.column("hits")[rows])
                row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
                gone = vec.covered(hits.astype(np.int64) + first[row], window, len(starts))
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[first[1:]] - sums[first[:-1]]
                data, kept, shas = buf.tobytes(), [], []
                for k in range(len(off) - 1):
                    own = range(first[k], first[k + 1])
                    if removed[k]:
                        left = b" ".join([data[starts[i] : ends[i]] for i in own if not gone[i]])
                    else:
                        left = b" ".join(data[off[k] : off[k + 1]].split())
                    kept.append(left.decode("utf-8"))
                    shas.append(hashlib.sha256(left).hexdigest())
                yield pa.record_batch(
                    [batch.column("doc_id")[rows], pa.array(np.diff(first)), pa.array(removed), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                )

    return run


def remove_earlier_passages(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = ANCHOR_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: without words of windows that start in a smaller doc_id."""
    got = repeated(docs, "word", window, gram, apart=True)
    mixed = got.mixed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shard(window, shard_bytes), "anchor long, segment long, least array<bigint>")
    # the first word of each window and the smallest document that has it; one value serves all windows of a lone segment
    least = got.alone.select("anchor", "segment", F.array("low").alias("least")).union(mixed)
    starts = F.expr("filter(transform(sequence(0, windows - 1), i -> if(least[if(size(least) = 1, 0, i)] < doc_id, start + i, -1)), x -> x >= 0)")
    hits = got.found.join(least, ["anchor", "segment"]).select(*got.keys, starts.alias("hits")).filter(F.size("hits") > 0)
    hits = hits.groupBy(*got.keys).agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return got.packed.join(hits, got.keys, "left").select("doc_id", "packed", "hits").mapInArrow(_cut(window), schema)


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = WINDOW_WORDS, shard_words: int = 50_000, max_words: int = REFERENCE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: without the maximal spans of at least ``min_words`` words that a text of
    ``reference`` has. The reference is counted first and refused beyond ``max_words``, as its automata are broadcast."""
    spark: SparkSession = docs.sparkSession
    total = reference.select(F.sum(F.regexp_count("text", F.lit(r"[^ \t-\r]+")))).first()[0] or 0
    if total > max_words:
        raise ValueError(f"the reference has {total} words; automata of more than {max_words} are not broadcast")
    shards, size = [SuffixAutomaton()], 0
    for (text,) in reference.select("text").filter("text is not null").collect():
        own = text.encode().split()
        if size and size + len(own) > shard_words:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(own)
        size += len(own)
    sent = spark.sparkContext.broadcast([(x.next, x.link, x.length) for x in shards])

    @vec.lean
    def run(batches):
        automata = []
        for x in sent.value:
            automata.append(a := SuffixAutomaton())
            a.next, a.link, a.length = x
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = (text or "").encode().split()
                gone = np.zeros(len(own), bool)
                for a in automata:
                    for k, (matched, _) in enumerate(a.statistics(own, min_words)):
                        if matched >= min_words:
                            gone[k - min_words + 1 : k + 1] = True
                out.append((doc, len(own), int(gone.sum()), b" ".join(w for w, g in zip(own, gone, strict=True) if not g).decode()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_earlier_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
