"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

No radius of fingerprints holds all such pairs, so candidates come from the sets: with the shingles of all texts in one
order, two similar sets share one of the first ``size - ceil(0.8 size) + 1`` of each. The order is cold shingles by
hash, then hot ones by their count in a sample; any order gives the same pairs, this one keeps groups small. Candidates
that the sizes and places of a shared shingle don't exclude are compared by exclusive-or and bit counts of the parities of
how many shingles each has in 1024 parts of the hashes, which the shingles that only one of them has bound from above;
pairs that remain are compared by their whole sets.

A sieve goes before: of two similar sets, the shingles of least hash, about a third of each, share many; a set that
has fewer of its own such shingles in common with all others together has no similar one and is left out.

Texts with one set of shingles are one node. Before all pairs of shared shingles are looked at, rounds link each node
with one other of those that share two min-hashes with it, so that a large group of copies is mostly one component;
pairs inside a component are then skipped, and groups that lie in one whole. Groups of hot shingles are dealt by pairs
of salts over many tasks.

Defined results: words are split at white space, ASCII upper case lowered; a text of fewer than five words is one
shingle; null, empty and blank texts are copies of each other. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .segments import answer, ask, unpack
from .shared import few, persisted
from .simhash import components

SHINGLE = 5
PERCENT = 80
#: Texts of the sample that finds hot shingles, and in how many of them a hot one is; neither changes the result.
SAMPLE, HOT = 5_000, 8
#: Nodes of a hot shingle that share a salt.
GROUP = 1000
#: Rounds of linking before all pairs, min-hash bands a round, min-hashes a band, nodes of a band that share a partner.
ROUNDS, BANDS, BAND_ROWS, PARTNERS = 1, 12, 2, 32
#: Earlier shingles of a set that go with each of its others, so that a pair that shares one is not dealt out again.
EARLIER = 24
#: Parts of the hashes whose parities are compared.
SKETCH_BITS = 1024
#: Percent of a set's shingles that two similar sets share, at least, among those of least hash.
SIEVE = 15
#: Bits of a shingle's hash that the sieve compares; chance repeats only let more sets through.
SIEVE_BITS = 44


_SEEDS = np.random.default_rng(20250101).integers(0, 2**64, ROUNDS * BANDS * BAND_ROWS, dtype=np.uint64)[None, :]


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[slice, list[tuple[int, np.ndarray]]]]:
    """Node and sorted distinct shingle hashes of each text, a piece of rows at a time."""
    for rows, buf, off in vec.pieces(column):
        starts, ends, first = vec.words(buf, off)
        tokens = vec.word_tokens(vec.LOWER[buf], starts, ends)
        found = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            size = min(shingle, int(b - a))
            own = np.unique(vec.mix(vec.Rolling(tokens[a:b]).grams(size) + np.uint64(size))) if size else np.zeros(0, np.uint64)
            found.append((xxhash.xxh64_intdigest(own.tobytes()), own))
        yield rows, found


def _nested(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _nodes(found: list[tuple[int, np.ndarray]]) -> pa.Array:
    return vec.longs(np.array([x for x, _ in found], np.uint64))


def _grams(shingle: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _sets(batch.column("text"), shingle):
                yield pa.record_batch([_nested([x for _, x in found], pa.int64())], ["grams"])

    return run


def bands(own: np.ndarray) -> np.ndarray:
    """Hash of each band of min-hashes of a set."""
    least = np.min(vec.mix(own[:, None] ^ _SEEDS), axis=0).reshape(-1, BAND_ROWS)
    out = np.zeros(len(least), np.uint64)
    for column in least.T:
        out = vec.mix(out + column)
    return out


def sketch(own: np.ndarray) -> bytes:
    """Parities of how many of a set lie in each of SKETCH_BITS parts of the hashes."""
    return np.packbits(np.bincount((own >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _marks(shingle: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _sets(batch.column("row").field("text"), shingle):
                yield pa.record_batch([batch.column("row")[rows], _nodes(found)], ["row", "node"])

    return run


def least(n: int, percent: int) -> int:
    """Of a set of n, by how many shingles a similar set shares at least."""
    return -(-percent * n // 100)


def _sieve(shingle: int, percent: int):
    """Pairs of a shingle and a node, of every set's first n - least(n) + SIEVE % of n by hash."""

    def find(batch: pa.RecordBatch, rows: slice, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        keys, nodes, sizes = [np.zeros(0, np.uint64)], [], []
        for _, found in _sets(batch.column("text")[rows], shingle):
            for node, own in found:
                n = len(own)
                if n:
                    keys.append(own[: n - least(n, percent) + max(1, SIEVE * n // 100)] >> np.uint64(64 - SIEVE_BITS))
                    nodes.append(node)
                    sizes.append(len(keys[-1]))
        return [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.uint64), sizes).view(np.int64)]

    return find


def candidates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node: those that may have a similar one. Two sets of sizes n and m, the one at least ``percent`` of the other,
    share as many of their first shingles as the lesser SIEVE % of them; ``percent`` of SIEVE % of n serves every m."""
    buckets = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = docs.select("text").mapInArrow(ask(_sieve(shingle, percent), True, buckets), "bucket int, known boolean, pairs binary")
    held = asked.repartition("bucket").select("known", "pairs").mapInArrow(answer(["node"], True, buckets // 4), "home int, pairs binary")
    held = held.repartition("home").sortWithinPartitions("home").mapInArrow(unpack(["node"]), "node long, wanted array<bigint>")
    return held.select("node", F.size(F.array_distinct("wanted")).alias("repeated"))


def _prefixes(shingle: int, percent: int, sent):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = sent.value
        for batch in batches:
            for _, found in _sets(batch.column("text"), shingle):
                keys, weights, banded = [], [], []
                for _, own in found:
                    weight = np.zeros(len(own), np.int32)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                        weight = np.where(hot[at] == own, counts[at], 0).astype(np.int32)
                    n = len(own) - least(len(own), percent) + 1 if len(own) else 0
                    order = np.lexsort((own, weight))[:n]
                    keys.append(own[order])
                    weights.append(weight[order])
                    banded.append(bands(own) if len(own) else own)
                sizes, grams = pa.array([len(x) for _, x in found], pa.int32()), _nested([x for _, x in found], pa.int64())
                sketches = pa.array([sketch(x) for _, x in found], pa.binary())
                yield pa.record_batch([_nodes(found), sizes, _nested(keys, pa.int64()), _nested(weights, pa.int32()), _nested(banded, pa.int64()), grams, sketches], ["node", "size", "keys", "weights", "bands", "grams", "sketch"])

    return run


def pairs_within(group: np.ndarray, rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of all pairs in a group with distinct labels that may be similar; of two salts, those of both."""
    # a group of one label has nothing to compare
    label = rows["label"]
    same = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    if len(same):
        mixed = np.minimum.reduceat(label, same) != np.maximum.reduceat(label, same)
        keep = np.repeat(mixed, np.diff(np.append(same, len(group))))
        group, rows = group[keep], {c: [x for x, k in zip(v, keep, strict=True) if k] if c == "before" else v[keep] for c, v in rows.items()}
    order = np.lexsort((rows["size"], group))
    prints, before = rows["sketch"][order], [rows["before"][k] for k in order]
    group, (node, size, pos, label, salt, both) = group[order], (rows[c][order].astype(np.int64) for c in ("node", "size", "pos", "label", "salt", "both"))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active, shift = np.arange(len(group)), 1
    while len(active):
        active = active[active + shift < len(group)]
        other = active + shift
        near = (group[other] == group[active]) & (size[other] * percent <= size[active] * 100)
        active, other = active[near], other[near]
        most = 1 + np.minimum(pos[active], pos[other]) + np.minimum((size - pos)[active], (size - pos)[other]) - 1
        hit = np.flatnonzero((label[active] != label[other]) & ((both[active] == 0) | (salt[active] != salt[other])) & (most * (100 + percent) >= percent * (size[active] + size[other])))
        apart = np.bitwise_count(prints[active[hit]] ^ prints[other[hit]]).sum(1, dtype=np.int64)
        hit = hit[apart * (100 + percent) <= (100 - percent) * (size[active[hit]] + size[other[hit]])]
        # a pair counts where its first common shingle is, as far as the earlier ones are there
        hit = hit[[before[x].isdisjoint(before[y]) for x, y in zip(active[hit].tolist(), other[hit].tolist(), strict=True)]] if len(hit) else hit
        left.append(node[active[hit]])
        right.append(node[other[hit]])
        shift += 1
    return np.concatenate(left), np.concatenate(right)


def _tiles(percent: int):
    def made(whole: pa.Table) -> pa.RecordBatch:
        rows = {c: whole.column(c).to_numpy() for c in whole.column_names if c not in ("sketch", "before")}
        rows["sketch"] = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(whole.num_rows, -1)
        rows["before"] = [frozenset(x) for x in whole.column("before").to_pylist()]
        new = np.zeros(whole.num_rows, np.int64)
        new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1])
        a, b = pairs_within(np.cumsum(new), rows, percent)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by key and tile; the last group may go on in the next batch
            if not batch.num_rows:
                continue
            key, tile = (batch.column(c).to_numpy() for c in ("key", "tile"))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            if held and (held[-1].column("key")[-1].as_py(), held[-1].column("tile")[-1].as_py()) != (key[0], tile[0]):
                yield made(pa.Table.from_batches(held))
                held = []
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def _similar(percent: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = (vec.lists(batch.column(c)) for c in ("grams", "others"))
            keep = []
            for k in range(batch.num_rows):
                p, q = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * (100 + percent) >= percent * (len(p) + len(q)))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("b").filter(mask), batch.column("a").filter(mask)], ["src", "dst"])

    return run


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """src, dst: the pairs (a, b) of nodes whose whole sets are similar; ``sets`` has node and grams."""
    pairs = persisted(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = sets.join(wanted, "node", "left_semi")
    both = pairs.join(own.withColumnRenamed("node", "a"), "a").join(own.select(F.col("node").alias("b"), F.col("grams").alias("others")), "b")
    return persisted(both.select("a", "b", "grams", "others").mapInArrow(_similar(percent), "src long, dst long"))


def partners(nodes: DataFrame, label: DataFrame | None, k: int, percent: int) -> DataFrame:
    """a, b: nodes of unlike labels that share a band of round k, each with the least of about PARTNERS of them."""
    own = nodes.select("node", "size", F.posexplode(F.slice("bands", k * BANDS + 1, BANDS)).alias("band", "value"))
    part = F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("n") / PARTNERS))
    own = own.join(own.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["band", "value"]).withColumn("part", part)
    own = own.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")) if label is not None else own.withColumn("label", F.col("node"))
    first = own.groupBy("band", "value", "part").agg(F.min(F.struct("node", "size", "label")).alias("first"))
    both = own.join(first, ["band", "value", "part"]).filter("label <> first.label AND node <> first.node")
    return both.filter((F.least("size", "first.size") * 100) >= F.greatest("size", "first.size") * percent).select(F.col("first.node").alias("a"), F.col("node").alias("b"))


def hot_shingles(docs: DataFrame, shingle: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in many texts of a sample, and in how many."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct().mapInArrow(_grams(shingle), "grams array<long>")
    found = some.select(F.explode("grams").alias("key")).groupBy("key").count().filter(F.col("count") >= HOT).collect()
    hot, counts = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    order = np.argsort(hot)
    return hot[order], counts[order]


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """node, label: of every node of several rows or with near copies, the least node that it reaches by them."""
    step = max(1, docs.count() // SAMPLE)
    sent = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, shingle, step))
    lists = ("keys", "weights", "bands", "grams", "sketch")
    known = persisted(candidates(docs, shingle, percent))
    found = docs.select("text").mapInArrow(_prefixes(shingle, percent, sent), "node long, size int, keys array<long>, weights array<int>, bands array<long>, grams array<long>, sketch binary").join(few(known), "node", "left")
    may = F.coalesce("repeated", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("size") * SIEVE * percent / 10000))
    nodes = found.select("node", "size", *[F.when(may, F.col(c)).alias(c) for c in lists])
    nodes = persisted(nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", *lists)], F.count(F.lit(1)).alias("n")))
    several, nodes = nodes.filter("n > 1").select("node"), nodes.filter("keys IS NOT NULL").drop("n")
    sets = nodes.select("node", "grams")

    links = label = None
    for k in range(ROUNDS):
        new = verified(sets, partners(nodes, label, k, percent), percent)
        links = new if links is None else links.union(new)
        label = components(links) if k == ROUNDS - 1 else components(links, 3, whole=False)

    posted = nodes.join(label, "node", "left").select("node", "size", F.coalesce("label", "node").alias("label"), F.posexplode(F.arrays_zip("keys", "weights")).alias("pos", "x"))
    posted = posted.select("node", "size", "label", "pos", F.col("x.keys").alias("key"), F.ceil(F.col("x.weights") * step / GROUP).cast("int").alias("salts"))
    # only shingles of several components, and only then with the sketches
    mixed = posted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    posted = posted.join(mixed, "key", "left_semi").join(nodes.select("node", "sketch", "keys"), "node").withColumn("before", F.slice("keys", 1, F.least("pos", F.lit(EARLIER))))
    salt = F.pmod(F.xxhash64("node"), F.greatest("salts", F.lit(1))).cast("int")
    # salt s meets salt t in tile (lesser, greater)
    tiles = F.expr("transform(sequence(0, greatest(salts, 1) - 1), t -> cast(least(salt, t) as long) * greatest(salts, 1) + greatest(salt, t))")
    dealt = posted.withColumn("salt", salt).withColumn("tile", F.explode(tiles))
    dealt = dealt.withColumn("both", (F.floor(F.col("tile") / F.greatest("salts", F.lit(1))) != F.col("tile") % F.greatest("salts", F.lit(1))).cast("int"))
    dealt = dealt.select("key", "tile", "node", "size", "pos", "label", "salt", "both", "sketch", "before").repartition("key", "tile").sortWithinPartitions("key", "tile")
    rest = verified(sets, dealt.mapInArrow(_tiles(percent), "a long, b long"), percent)
    return several.join(components(links.union(rest)), "node", "full").select("node", F.coalesce("label", "node").alias("label"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last; of several with it, the least row hash."""
    label = few(persisted(near_copies(docs, shingle, percent)))
    rows = docs.select(F.struct("*").alias("row"))  # any names may be in it
    marked = rows.mapInArrow(_marks(shingle), f"row {rows.schema['row'].dataType.simpleString()}, node long")
    rank = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row"))
    kept = marked.join(label, "node").groupBy("label").agg(F.min_by("row", rank).alias("row"))
    return marked.join(label, "node", "left_anti").select("row").union(kept.select("row")).select("row.*")
