"""Near copies by b-bit MinHash: texts whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

Of each distinct set (a node) K = BANDS * ROWS minima are taken under random affine permutations. Bands of ROWS whole minima make the
candidates: two sets that share a band. Of each minimum only BITS low bits are kept, packed to K * BITS bits. Two packed
signatures are compared by exclusive-or and bit counts; equal low bits may be chance, which the estimate takes out:
J = (equal / K - c) / (1 - c), c = 2 ** -BITS. A candidate goes on if its estimate isn't so far below ``percent`` that a pair
at it would fall there with a probability of MISS; beside it stands a bound without chance, the parities of how many
shingles lie in each part of the hashes. What is left is confirmed on the whole sets. A pair at 0.8 shares no band with a
probability of (1 - 0.8 ** ROWS) ** BANDS = 7e-10; nothing else can lose it.

A group of copies isn't paired out. First each node meets one node of about PARTNERS of the same band, then one node of
the least component in each of its bands, and of these it keeps the best few estimates: that makes a large group one component. Only bands
that still hold several components are compared in full, in tiles of salted halves where a band is large, and only nodes
of different components. A band's size is counted over all nodes.

Defined results: ASCII upper case is lowered; words are split at space and 9 to 13; a text of fewer words than a
shingle is one shingle; null, empty and blank texts have no shingles and are linked with nothing, so a component of their
own each; rows with one doc_id each give a row; rows without doc_id take part, and a component that has no other
rows has component_id null; ``kept`` is doc_id = component_id, where null equals null; shingles, sets and texts are told apart by
64-bit hashes; other columns are not read; an empty table gives an empty result; very long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .near_copies import _nested, _nodes, _sets, sketch
from .shared import few, persisted
from .simhash import components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, BITS = 40, 4, 4
MISS = 1e-9
#: Bands of the first round, nodes of a band that share a partner there, partners that a node keeps, nodes of a salt.
STARS, PARTNERS, BEST, GROUP = 8, 32, 3, 1000
#: Shingles whose minima are taken at once.
CHUNK = 1 << 15

_RANDOM = np.random.default_rng(20240911)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each set of hashes, a row each; none may be empty."""
    out = np.full((len(sets), len(_TIMES)), np.iinfo(np.uint64).max, np.uint64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for k in range(0, len(flat), CHUNK):
        part, own = flat[k : k + CHUNK], row[k : k + CHUNK]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows = own[begin]
        for j, (a, b) in enumerate(zip(_TIMES, _PLUS, strict=True)):
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(part * a + b, begin))
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One hash of each band of minima, apart for each band."""
    bands = low.reshape(len(low), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        out = vec.mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, as whole 64-bit words."""
    bits = (vec.mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), low.shape[1] * BITS // 64, 64 // BITS)
    return (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of two packed signatures have equal low bits."""
    apart = a ^ b
    for k in range(BITS.bit_length() - 1):
        apart |= apart >> np.uint64(1 << k)
    return len(_TIMES) - np.bitwise_count(apart & _ONES).sum(-1, dtype=np.int64)


def estimate(same: np.ndarray) -> np.ndarray:
    """Similarity from equal low bits, less those that are equal by chance."""
    chance = 2.0**-BITS
    return (same / len(_TIMES) - chance) / (1 - chance)


def least_equal(percent: int) -> int:
    """So many low bits are equal, but for a probability of MISS, if the similarity is ``percent``."""
    n, p, total = len(_TIMES), 2.0**-BITS + (1 - 2.0**-BITS) * percent / 100, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > MISS:
            return k
    return n


def _marks(shingle: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _sets(batch.column("text"), shingle):
                some = [x for _, x in found if len(x)]
                low = minima(some) if some else np.zeros((0, len(_TIMES)), np.uint64)
                keys, bits = iter(band_keys(low)), iter(packed(low))
                own = [(next(keys), next(bits).tobytes(), sketch(x)) if len(x) else (x, b"", b"") for _, x in found]
                sizes = pa.array([len(x) for _, x in found], pa.int64())
                columns = [_nested([k for k, *_ in own], pa.int64()), pa.array([b for _, b, _ in own], pa.binary()), pa.array([s for *_, s in own], pa.binary())]
                yield pa.record_batch([batch.column("doc_id")[rows], batch.column("hash")[rows], _nodes(found), sizes, *columns], ["doc_id", "hash", "node", "size", "bands", "bits", "parities"])

    return run


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, hash (of the text), node (hash of its set), size, bands, bits and parities of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(_marks(shingle), "doc_id long, hash long, node long, size long, bands array<long>, bits binary, parities binary")


def _words(column: pa.Array) -> np.ndarray:
    """A binary column of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _may(bits: np.ndarray, parities: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) those that may be similar, and how many low bits are equal."""
    both = size[a] + size[b]
    keep = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
    a, b, both = a[keep], b[keep], both[keep]
    same = equal(bits[a], bits[b])
    keep[keep] = fine = same >= least
    a, b, both, same = a[fine], b[fine], both[fine], same[fine]
    apart = np.bitwise_count(parities[a] ^ parities[b]).sum(1, dtype=np.int64)
    keep[keep] = fine = apart * (100 + percent) <= (100 - percent) * both
    return keep, same[fine]


def _rated(percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits, parities = (np.concatenate([_words(batch.column(c)) for c in (x, f"{x}_b")]) for x in ("bits", "parities"))
            size = np.concatenate([batch.column(c).to_numpy() for c in ("size", "size_b")])
            keep, same = _may(bits, parities, size, np.arange(n), np.arange(n, 2 * n), percent, least)
            mask = pa.array(keep)
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(same)], ["a", "b", "same"])

    return run


def best(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: of the pairs that may be similar, those of the BEST highest estimates of each b."""
    own = nodes.select("node", "size", "bits", "parities")
    other = own.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("size", "bits", "parities")])
    both = pairs.join(own.withColumnRenamed("node", "a"), "a").join(other, "b")
    rated = both.mapInArrow(_rated(percent, least_equal(percent)), "a long, b long, same long")
    # a list has at most a partner for each band
    some = rated.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("same", "a")), asc=False), 1, BEST).alias("some"))
    return some.select("b", F.explode("some.a").alias("a"))


def _similar(shingle: int, percent: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([x for _, found in _sets(vec.unpack(batch.column(c)), shingle) for _, x in found] for c in ("text", "text_b"))
            keep = []
            for p, q in zip(left, right, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * 100 >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("b").filter(mask), batch.column("a").filter(mask)], ["src", "dst"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("node"), vec.pack(batch.column("text"))], ["node", "text"])


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """src, dst: the pairs (a, b) of nodes whose whole sets are similar."""
    pairs = persisted(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "hash"), "node")
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(few(persisted(wanted)), "hash").groupBy("node").agg(F.first("text").alias("text"))
    texts = persisted(texts.select("node", "text").mapInArrow(_pack, "node long, text binary"))
    both = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return persisted(both.select("a", "b", "text", "text_b").mapInArrow(_similar(shingle, percent), "src long, dst long"))


def posted(nodes: DataFrame) -> DataFrame:
    """key, node, size, band, n: the bands that several nodes share, and how many do; most bands are of one node."""
    own = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    return persisted(own.join(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))


def stars(posts: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes that share one of the first STARS bands, each with the least of about PARTNERS of them."""
    own = posts.filter(F.col("band") < STARS)
    own = own.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PARTNERS)))
    first = own.groupBy("key", "part").agg(F.min(F.struct("node", "size")).alias("first"))
    both = own.join(first, ["key", "part"]).filter("node <> first.node")
    near = F.least("size", "first.size") * 100 >= F.greatest("size", "first.size") * percent
    return both.filter(near).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def mixed(posts: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, size, label, key) of shared bands; (key, n, low) of bands of several components: nodes, a node of the least."""
    own = posts.join(few(label), "node", "left").select("node", "size", F.coalesce("label", "node").alias("label"), "key")
    least = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("label", "node", "size")).alias("low"), F.max("label").alias("high"))
    return own, least.filter("low.label < high").drop("high")


def outsiders(posts: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """a, b: a node of the least component of a band, and each node of other components there."""
    own, least = mixed(posts, label)
    both = own.join(least, "key").filter("label <> low.label")
    near = F.least("size", "low.size") * 100 >= F.greatest("size", "low.size") * percent
    return both.filter(near).select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()


def pairs_of(group: np.ndarray, label: np.ndarray, side: np.ndarray, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group with unlike labels, in pieces; where ``both`` is set also on unlike sides. Rows of a
    group lie together. Small groups go together, a distance at a time; in a large one the rows that aren't of its
    commonest label meet all others."""
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(group)))
    small = np.repeat(sizes <= 64, sizes)
    fits = lambda a, b: (label[a] != label[b]) & ((both[a] == 0) | (side[a] != side[b]))
    active, shift = np.flatnonzero(small), 1
    while len(active):
        active = active[active + shift < len(group)]
        active = active[group[active + shift] == group[active]]
        hit = active[fits(active, active + shift)]
        if len(hit):
            yield hit, hit + shift
        shift += 1
    for at, n in zip(begin[sizes > 64], sizes[sizes > 64], strict=True):
        own = np.arange(at, at + n)
        values, counts = np.unique(label[own], return_counts=True)
        rare = label[own] != values[counts.argmax()]
        others = np.concatenate([own[~rare], own[rare]])
        for k, row in enumerate(own[rare]):
            rest = others[: (~rare).sum() + k]
            rest = rest[fits(np.full(len(rest), row), rest)]
            if len(rest):
                yield np.full(len(rest), row), rest


def _tiles(percent: int, least: int):
    def made(whole: pa.Table) -> pa.RecordBatch:
        rows = {c: whole.column(c).to_numpy() for c in ("key", "tile", "node", "size", "label", "salt", "both")}
        bits, parities = (_words(whole.column(c)) for c in ("bits", "parities"))
        group = np.cumsum(np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1])])
        found = [np.zeros((0, 2), np.int64)]
        for a, b in pairs_of(group, rows["label"], rows["salt"], rows["both"]):
            keep, _ = _may(bits, parities, rows["size"], a, b, percent, least)
            x, y = rows["node"][a[keep]], rows["node"][b[keep]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted by key and tile; the last group may go on in the next batch
            if not batch.num_rows:
                continue
            key, tile = (batch.column(c).to_numpy() for c in ("key", "tile"))
            if held and last != (key[0], tile[0]):
                yield made(pa.Table.from_batches(held))
                held = []
            last = key[-1], tile[-1]
            cut = len(key) - int(np.argmax(((key != last[0]) | (tile != last[1]))[::-1])) if (key[0], tile[0]) != last else 0
            if cut:
                yield made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def remaining(nodes: DataFrame, posts: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs that share a band and are of different components, as far as they may be similar."""
    own, least = mixed(posts, label)
    own = own.join(least.select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "key")
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # salt s meets salt t in tile (lesser, greater)
    tiles = F.expr("transform(sequence(0, salts - 1), t -> cast(least(salt, t) as long) * salts + greatest(salt, t))")
    own = own.withColumn("tile", F.explode(tiles))
    own = own.withColumn("both", (F.floor(F.col("tile") / F.col("salts")) != F.col("tile") % F.col("salts")).cast("int"))
    own = own.join(nodes.select("node", "bits", "parities"), "node")
    dealt = own.select("key", "tile", "node", "size", "label", "salt", "both", "bits", "parities").repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_tiles(percent, least_equal(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = persisted(marked(docs, shingle))
    nodes = persisted(rows.filter("size > 0").drop("doc_id").dropDuplicates(["node"]))
    posts = posted(nodes)
    links = confirmed(docs, nodes, best(nodes, stars(posts, percent), percent), shingle, percent)
    label = components(links, 3, whole=False)
    links = links.union(confirmed(docs, nodes, best(nodes, outsiders(posts, label, percent), percent), shingle, percent))
    label = components(links, 3, whole=False, known=label)
    rest = confirmed(docs, nodes, remaining(nodes, posts, label, percent), shingle, percent)
    label = components(links.union(rest), known=label)
    # only sets of several rows or with links have another component than their row
    own = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).join(label, "node", "left")
    own = own.filter("n > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    lowest = own.groupBy("label").agg(F.min("first").alias("lowest"))
    known = own.select("node", "label").join(lowest, "label").select("node", "lowest", F.lit(True).alias("known"))
    out = rows.select("doc_id", "node", "size").join(few(persisted(known)), "node", "left")
    out = out.withColumn("component_id", F.when(F.expr("known AND size > 0"), F.col("lowest")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
