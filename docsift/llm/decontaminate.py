"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND.

Tokens are runs of letters and digits, ASCII upper case lowered. Counts over all items (their number, mean length and how
many hold a term) are taken once, so that a score doesn't depend on how the index is cut into shards. A shard's index
holds, in flat arrays, each term's greatest impact on each block of items that it is in, and the postings of each block.

For an item a document is cut into passages of twice as many tokens as the item has, up to the next power of two (STEP at
least), each beginning half-way through the one before, so that every occurrence of an item lies whole in one passage and
no other item, and no cut into shards, has a say in it. Items of one such length share an index. A passage is a query of its distinct terms. Terms whose
greatest impacts together stay below the threshold can't lift an item alone: they are looked at only for passages that the
others let through. Of such a passage the block maxima are added up first; only blocks whose sum reaches the threshold
are opened, and only their postings are read.

The threshold of an item is its own score less its greatest impacts, one for each term that may be missing while
``min_overlap`` of its shingles are still there, so that retrieval loses nothing that verification would accept.
Verification counts the item's shingles of five words in the passage: all, those of the question (all sentences but the
last) and those of the answer (the last).

Defined results: null texts have no passages; rows without doc_id are searched like any other; items without tokens match
nothing; equal items each get their row; a document's row for an item is its best passage's; repeated documents each get
their rows; an empty benchmark or no documents give an empty result; other columns are not read. The index is broadcast
in shards of about ``max_tokens`` tokens, halved until they have at most ``max_bytes`` bytes, and documents are read once a
shard; the rows are the same for any such bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

SHINGLE = 5
MIN_OVERLAP = 0.8
MIN_PART = 0.5
BLOCK = 16
#: Tokens by which the passages of short items begin one after the other.
STEP = 32
K1, B = 1.2, 0.75
MAX_TOKENS = 500_000
#: Block maxima, and bounds of passages and blocks, that are added up at once.
EXPANDED = 1 << 20
#: Of a shard's index as it is sent.
MAX_BYTES = 256 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and end of every token, and each row's first token."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _WORD[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return vec.word_tokens(vec.LOWER[buf], starts, ends), ends, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return vec.mix(vec.Rolling(hashes).grams(size) + np.uint64(size))


@dataclass
class Counts:
    """Over all items: how many have tokens, their mean length, and how many of them hold each term."""

    items: int
    mean: float
    terms: np.ndarray  #: sorted hashes, of those needed at least
    df: np.ndarray


@dataclass
class Index:
    """Flat arrays. A term's maxima lie at maxima[term_at[t] : term_at[t + 1]], a block's postings, by term, at
    block_at[b] : block_at[b + 1]. Impacts and maxima are shares of the item's threshold."""

    ids: np.ndarray
    vocabulary: np.ndarray  #: sorted term hashes
    term_at: np.ndarray
    in_block: np.ndarray
    maxima: np.ndarray
    most: np.ndarray  #: by term
    essential: np.ndarray  #: by term
    rest: np.ndarray  #: by block: what all other terms can add
    block_at: np.ndarray
    posting_term: np.ndarray
    posting_item: np.ndarray
    impact: np.ndarray
    part_size: np.ndarray  #: by item and part (whole, question, answer): the shingle size
    part_at: np.ndarray
    part_hash: np.ndarray
    step: int  #: tokens by which passages begin one after the other

    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self) if f.name != "step")


def step_of(tokens: int) -> int:
    """By which the passages of an item of so many tokens begin one after the other."""
    return max(STEP, 1 << max(0, tokens - 1).bit_length())


def _parts(text: bytes, hashes: np.ndarray, ends: np.ndarray) -> list:
    cuts = [i + 1 for i, c in enumerate(text) if c in b".?!\n"]
    n, split = len(hashes), 0
    for cut in reversed(cuts):
        split = int(np.searchsorted(ends, cut, "right"))
        if split < n:
            break
    if not 0 < split < n:
        split = 0
    spans = [(0, n), (0, split), (split, n)] if split else [(0, n)] * 3
    out = []
    for a, b in spans:
        size = min(SHINGLE, b - a)
        out.append((size, np.unique(shingles(hashes[a:b], size))))
    return out


def build(items: list[tuple[int, str]], counts: Counts | None = None, min_overlap: float = MIN_OVERLAP) -> Index | None:
    """The index of some items, searched by the passages of the longest; without ``counts`` these are all there are."""
    kept = []
    for item, text in items:
        raw = (text or "").encode()
        hashes, ends, _ = tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(hashes):
            kept.append((item, raw, hashes, ends))
    if not kept:
        return None
    n = len(kept)
    vocabulary = np.unique(np.concatenate([h for _, _, h, _ in kept]))
    terms = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for _, _, h, _ in kept]
    if counts is None:
        df = np.bincount(np.concatenate([t for t, _ in terms]), minlength=len(vocabulary))
        counts = Counts(n, float(np.mean([len(h) for _, _, h, _ in kept])), vocabulary, df)
    df = counts.df[np.searchsorted(counts.terms, vocabulary)]
    idf = np.log(1 + (counts.items - df + 0.5) / (df + 0.5))
    parts = [_parts(raw, h, e) for _, raw, h, e in kept]
    impacts = []
    for (t, tf), (_, _, h, _), own in zip(terms, kept, parts, strict=True):
        score = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / counts.mean))
        missing = int((1 - min_overlap) * len(own[0][1]) + 1e-9)
        impacts.append(score / (np.sort(score)[: max(1, len(score) - missing)].sum() * (1 - 1e-9)))
    term, item, impact = np.concatenate([t for t, _ in terms]), np.repeat(np.arange(n), [len(t) for t, _ in terms]), np.concatenate(impacts)
    block = item // BLOCK
    order = np.lexsort((item, term, block))
    term, item, impact, block = term[order], item[order], impact[order], block[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    maxima, max_term, max_block = np.maximum.reduceat(impact, first), term[first], block[first]
    by_term = np.lexsort((max_block, max_term))
    maxima, max_term, max_block = maxima[by_term], max_term[by_term], max_block[by_term]
    term_at = np.searchsorted(max_term, np.arange(len(vocabulary) + 1))
    most = np.maximum.reduceat(maxima, term_at[:-1])
    # low-impact terms, as long as all blocks stay below the threshold without any other term
    essential, sums = np.ones(len(vocabulary), bool), np.zeros(-(-n // BLOCK))
    for t in np.argsort(most, kind="stable"):
        own = slice(term_at[t], term_at[t + 1])
        if (sums[max_block[own]] + maxima[own]).max() >= 0.5:
            break
        sums[max_block[own]] += maxima[own]
        essential[t] = False
    hashes = [x for own in parts for _, x in own]
    return Index(
        np.array([k for k, *_ in kept]), vocabulary, term_at, max_block, maxima, most, essential, sums, np.searchsorted(block, np.arange(len(sums) + 1)), term, item, impact,
        np.array([[size for size, _ in own] for own in parts]), np.concatenate([[0], np.cumsum([len(x) for x in hashes])]), np.concatenate(hashes), max(step_of(len(h)) for _, _, h, _ in kept),
    )


def blocks_to_open(index: Index, passage: np.ndarray, terms: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages (numbered from 0, in order) and their blocks whose maxima, of the passage's essential terms and of all
    others, add up to the threshold. Without an essential term a block has its rest, which stays below."""
    begin, blocks = index.term_at[terms], len(index.rest)
    count = index.term_at[terms + 1] - begin
    at = vec.ranges(begin, count)
    bound = np.bincount(np.repeat(passage, count) * blocks + index.in_block[at], index.maxima[at], passages * blocks)
    reached = np.flatnonzero(bound.reshape(passages, blocks) + index.rest >= 1)
    return reached // blocks, reached % blocks


def open_blocks(index: Index, blocks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of the blocks that reach their thresholds, with their scores over them, of a passage's terms (sorted)."""
    items, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    for b in blocks:
        own = slice(index.block_at[b], index.block_at[b + 1])
        place = np.minimum(np.searchsorted(inside, index.posting_term[own]), len(inside) - 1)
        held = inside[place] == index.posting_term[own]
        score = np.bincount(index.posting_item[own][held] - b * BLOCK, index.impact[own][held], BLOCK)
        hit = np.flatnonzero(score >= 1)
        items.append(hit + b * BLOCK)
        scores.append(score[hit])
    return np.concatenate(items), np.concatenate(scores)


def search(index: Index, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """row, item, score over threshold, and overlaps (whole, question, answer) of all retrieved pairs, best passage each."""
    at = np.searchsorted(index.vocabulary, hashes)
    at[at == len(index.vocabulary)] = 0
    known = index.vocabulary[at] == hashes
    where = np.flatnonzero(known)
    term = at[where]
    strong = index.essential[term]
    pos, strong_term = where[strong], term[strong]
    if not len(pos):
        return []
    step = index.step
    row = np.searchsorted(first, pos, "right") - 1
    half = (pos - first[row]) // step
    # a half lies in the passage that it begins and in the one before
    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // step) + 1)])
    passage = np.concatenate([base[row] + half, base[row] + half - 1])
    terms = np.concatenate([strong_term, strong_term])
    real = np.concatenate([np.ones(len(half), bool), half > 0])
    pairs = np.unique(passage[real] * len(index.vocabulary) + terms[real])
    passage, terms = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    # first by the greatest impacts anywhere, then block by block
    bound = np.add.reduceat(index.most[terms], begin) + index.rest.max()
    out: dict[tuple[int, int], tuple] = {}
    ends = np.append(begin[1:], len(terms))
    # so many passages at a time that their expanded maxima and bounds stay small
    most = np.concatenate([[0], np.cumsum((index.term_at[terms + 1] - index.term_at[terms]))])[np.append(begin, len(terms))]
    opened: list[tuple[int, np.ndarray]] = []
    start = 0
    while start < len(begin):
        end = min(int(np.searchsorted(most, most[start] + EXPANDED, "right")) - 1, start + EXPANDED // len(index.rest))
        end = min(max(end, start + 1), len(begin))
        chosen = slice(begin[start], ends[end - 1])
        which, block = blocks_to_open(index, np.repeat(np.arange(end - start), ends[start:end] - begin[start:end]), terms[chosen], end - start)
        cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else np.zeros(1, np.int64)
        opened += [(start + int(which[i]), block[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        start = end
    for k, blocks in opened:
        if bound[k] < 1:
            continue
        p = int(passage[begin[k]])
        r = int(np.searchsorted(base, p, "right") - 1)
        a = int(first[r] + (p - base[r]) * step)
        b = int(min(a + 2 * step, first[r + 1]))
        inside = np.unique(term[np.searchsorted(where, a) : np.searchsorted(where, b)])
        made: dict[int, np.ndarray] = {}
        for item, score in zip(*open_blocks(index, blocks, inside), strict=True):
            shares = []
            for part, size in enumerate(index.part_size[item].tolist()):
                if size not in made:
                    made[size] = shingles(hashes[a:b], size)
                cut = 3 * item + part
                shares.append(float(np.isin(index.part_hash[index.part_at[cut] : index.part_at[cut + 1]], made[size]).mean()))
            key, new = (r, int(item)), (round(shares[0], 6), round(float(score), 6), *(round(x, 6) for x in shares[1:]))
            if key not in out or out[key] < new:
                out[key] = new
    return [(r, item, x[1], x[0], x[2], x[3]) for (r, item), x in out.items()]


@vec.lean
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every item with tokens: whether it is the item's first row, its length, and each of its terms once."""
    for batch in batches:
        for rows, buf, off in vec.pieces(batch.column("text")):
            hashes, _, first = tokens(buf, off)
            shard = batch.column("shard")[rows].to_numpy()
            for k in range(len(off) - 1):
                own = np.unique(hashes[first[k] : first[k + 1]])
                if len(own):
                    length = np.zeros(len(own), np.int64)
                    length[0] = first[k + 1] - first[k]
                    yield pa.record_batch([vec.longs(own), pa.array(length), pa.array(np.full(len(own), shard[k]))], ["term", "length", "shard"])


def _built(items: list[tuple[int, str]], counts: Counts, min_overlap: float, max_bytes: int) -> Iterator[list[Index]]:
    """Indexes of items by their steps, that are together at most ``max_bytes``; a single item may have more."""
    by_step: dict[int, list[tuple[int, str]]] = {}
    for item, text in items:
        raw = (text or "").encode()
        by_step.setdefault(step_of(len(tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])), []).append((item, text))
    made = [x for own in by_step.values() if (x := build(own, counts, min_overlap))]
    if sum(x.nbytes() for x in made) <= max_bytes or len(items) == 1:
        yield made
    else:
        for part in (items[: len(items) // 2], items[len(items) // 2 :]):
            yield from _built(part, counts, min_overlap, max_bytes)


def shards(benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, max_tokens: int = MAX_TOKENS, max_bytes: int = MAX_BYTES) -> Iterator[list[Index]]:
    """Indexes of all items, a list for each shard, built one after the other; a shard's items and counts are all that
    reaches the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    n = -(-words // max_tokens) or 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long"))
    terms = items.mapInArrow(_item_terms, "term long, length long, shard long")
    whole = terms.agg(F.count(F.when(F.col("length") > 0, 1)).alias("n"), F.sum("length").alias("total")).first()
    if not whole["n"]:
        return
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards"))
    for k in range(n):
        got = df.filter(F.array_contains("shards", F.lit(k).cast("long"))).select("term", "df").toPandas()
        held = got["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(held)
        counts = Counts(whole["n"], whole["total"] / whole["n"], held[order], got["df"].to_numpy()[order])
        rows = items.filter(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            yield from filter(None, _built([(r.item_id, r.text) for r in rows], counts, min_overlap, max_bytes))


_FOUND = {"doc_id": pa.int64(), "text_key": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "overlap": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
_SCHEMA = "doc_id long, text_key long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, min_part: float = MIN_PART, max_tokens: int = MAX_TOKENS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text_key, item_id, score, overlap, question_overlap, answer_overlap of every verified pair."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = None
    for shard in shards(benchmark, min_overlap, max_tokens, max_bytes):
        sent = spark.sparkContext.broadcast(shard)

        @vec.lean
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, buf, off in vec.pieces(batch.column("text")):
                    hashes, _, first = tokens(buf, off)
                    got = [(r, index.ids[i], *x) for index in sent.value for r, i, *x in search(index, hashes, first) if x[1] >= min_overlap and min(x[2:]) >= min_part]
                    if got:
                        docs, keys = (batch.column(c)[rows].to_pylist() for c in ("doc_id", "text_key"))
                        cols = zip(*[(docs[r], keys[r], *x) for r, *x in got], strict=True)
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _FOUND.values(), strict=True)], list(_FOUND))

        one = keyed.mapInArrow(run, _SCHEMA)
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], _SCHEMA) if found is None else found


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item. Rows are known by doc_id, null like any other,
    and text, so that only those of several texts with one doc_id go that hold an item."""
    bad = leaks(docs, benchmark).select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_key"] == bad["text_key"]), "left_anti").select("row.*")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).drop("text_key")
