"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

A fingerprint bit is the majority of that bit over the XXH64 of all shingles of three words. Distinct fingerprints
are cut into blocks of bits; two that differ in at most ``radius`` bits agree in at least one of ``radius`` + 1 blocks,
so tiles are the fingerprints with one block's value (more blocks, several at once, for larger corpora: see
``tables``) and one of two neighbouring ranges of population counts: tiles whose counts differ beyond the radius never
meet. Within a tile, fingerprints are sorted by population count and compared exactly by numpy exclusive-or and bit
counts. A tile returns a spanning forest of its links, never all its pairs, and components grow by minimum labels with
pointer jumping over checkpointed tables.

Defined results: a null text has no words and so fingerprint zero, like an empty one; rows with one doc_id each get a
fingerprint; a row without doc_id gets one too and is its component's id only if nothing else is there (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .shared import few, in_parts, persisted

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Labels that are still broadcast in each round of components.
SENT = 200_000


def _majority(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for batch in batches:
            for rows, buf, off in vec.pieces(batch.column("text")):
                data = vec.LOWER[buf].tobytes()
                out = np.zeros(len(off) - 1, np.uint64)
                for k in range(len(off) - 1):
                    own = data[off[k] : off[k + 1]].split()
                    if not own:
                        continue
                    line = b" ".join(own)
                    ends = np.cumsum([len(w) + 1 for w in own]) - 1
                    n = max(1, len(own) - shingle + 1)
                    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
                    stops = ends[min(shingle, len(own)) - 1 :].tolist()
                    out[k] = _majority(np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64))
                yield pa.record_batch([batch.column("doc_id")[rows], vec.longs(out)], ["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle, seed), "doc_id long, bits long")


def tables(n: int, radius: int) -> list[int]:
    """Masks such that fingerprints within the radius agree under at least one: of all but ``radius`` blocks. More
    blocks make smaller tiles and more tables; 16 bits a tile do up to about 2**26 fingerprints, then 21 and 32."""
    extra = 1 if n < 1 << 26 else 2 if n < 1 << 31 else 3
    blocks = radius + extra
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, extra)]


def link_tile(bits: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within groups: each fingerprint's index and the least index it reaches."""
    n = len(bits)
    weight = np.bitwise_count(bits)
    order = np.lexsort((weight, group))
    bits, group, weight = bits[order], group[order], weight[order].astype(np.int64)
    root = np.arange(n)
    active, shift = np.arange(n), 1
    while len(active):
        active = active[active + shift < n]
        other = active + shift
        near = (group[other] == group[active]) & (weight[other] - weight[active] <= radius)
        active, other = active[near], other[near]
        hit = np.bitwise_count(bits[active] ^ bits[other]) <= radius
        left, right = active[hit], other[hit]
        while len(left):  # union by least root, all pairs of this distance at once
            a, b = root[left], root[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (jump := root[root]).tobytes() != root.tobytes():
                root = jump
        shift += 1
    child = np.flatnonzero(root != np.arange(n))
    return order[child], order[root[child]]


def _tiles(masks: list[int], radius: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            node, bits, table, span = (whole.column(c).to_numpy() for c in ("node", "bits", "tile", "span"))
            bits = bits.view(np.uint64)
            salt = vec.mix((table.astype(np.uint64) << np.uint64(8)) + span.astype(np.uint64) + np.uint64(1))
            key = vec.mix((bits & np.array(masks, np.uint64)[table]) ^ salt)
            a, b = link_tile(bits, key, radius)
            yield pa.record_batch([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["src", "dst"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = 200_000) -> DataFrame:
    """src, dst: links between the nodes of distinct ``bits`` that span all pairs within the radius."""
    n = nodes.count()
    masks = tables(n, radius)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // tile_rows))
    tiled = nodes.withColumn("tile", F.explode(F.array(*[F.lit(k) for k in range(len(masks))])))
    value = F.element_at(F.array(*[F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]), F.col("tile") + 1)
    # ranges of radius + 1 counts: within the radius two lie in one range or in neighbours, which meet in the lower's tile
    count = F.floor(F.bit_count("bits") / (radius + 1)).cast("int")
    spans = F.explode(F.array(count, count - 1)).alias("span")
    tiled = tiled.withColumn("value", value).select("node", "bits", "tile", "value", spans)
    return tiled.repartition(parts, "tile", "value", "span").select("node", "bits", "tile", "span").mapInArrow(_tiles(masks, radius), "src long, dst long").distinct()


def components(edges: DataFrame, rounds: int = 60, whole: bool = True, known: DataFrame | None = None) -> DataFrame:
    """node, label: the least node that each node of ``edges`` (src, dst) reaches; if not ``whole``, one that it reaches
    within so many rounds. ``known``: labels of some of the edges, to begin with."""
    both = persisted(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = persisted(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")))
    if known is not None:
        before = known.select("node", F.col("label").alias("known"))
        labels = persisted(labels.join(before, "node", "left").select("node", F.least("label", "known").alias("label")))
    both, n = in_parts(both, both.count()), labels.count()
    labels = in_parts(labels, n)
    for _ in range(rounds):
        sent = F.broadcast(labels) if n <= SENT else labels
        seen = both.join(sent.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("seen"))
        near = seen.join(sent, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = sent.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = near.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "further"), "label").alias("label"), "was")
        new = persisted(in_parts(new, n))
        labels = new.select("node", "label")
        if whole and not new.filter(F.col("label") < F.col("was")).limit(1).count():
            return labels
    if not whole:
        return labels
    raise RuntimeError(f"components still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, bits, component_id: the smallest doc_id reached by links, itself included."""
    marked = persisted(fingerprints(docs, shingle, seed))
    nodes = persisted(marked.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("node")).select("node", "bits"))
    label = components(links(nodes, radius))
    named = nodes.join(label, "node", "left").select("bits", F.coalesce("label", "node").alias("component_id"))
    return marked.join(named, "bits", "left")


def _marks(shingle: int, seed: int):
    marked = _fingerprints(shingle, seed)

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            own = pa.record_batch([pa.array(np.arange(len(rows))), rows.field("text")], ["doc_id", "text"])
            for found in marked([own]):
                yield pa.record_batch([rows.take(found.column("doc_id")), found.column("bits")], ["row", "bits"])

    return run


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component of linked fingerprints: the smallest doc_id, null last; of several with it, the least row
    hash. Rows are told apart by their fingerprints alone, so those without doc_id and unlike texts with one stay."""
    nodes = persisted(fingerprints(docs.select(F.lit(None).alias("doc_id"), "text"), shingle, seed).groupBy(F.col("bits").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    label = components(links(nodes.select("node", F.col("node").alias("bits")), radius))
    groups = persisted(nodes.join(label, "node", "left").filter("n > 1 OR label IS NOT NULL").select(F.col("node").alias("bits"), F.coalesce("label", "node").alias("label")))
    # most rows are in no group; they are not moved
    rows = docs.select(F.struct("*").alias("row"))  # any names may be in it
    marked = rows.mapInArrow(_marks(shingle, seed), f"row {rows.schema['row'].dataType.simpleString()}, bits long")
    marked = marked.join(few(groups), "bits", "left")
    rank = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row"))
    kept = marked.filter("label IS NOT NULL").groupBy("label").agg(F.min_by("row", rank).alias("row"))
    return marked.filter("label IS NULL").select("row").union(kept.select("row")).select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
