"""Whitening of embeddings by a tall-skinny QR factorisation (TSQR); no covariance is ever formed.

Entries become whole numbers of 1/64 (``quantised``), so that sums over all rows are exact whatever the order. The fit list is every
distinct vector once. Its rows, centred by the exact sums, are factored partition by partition into triangles R, which
are merged in a tree of FAN at a time; rows and triangles have as many columns as the vectors have entries, so a task
holds a block of rows and a few triangles. Of the last R the singular values s and right vectors V give the components:
the covariance is V diag(s * s / n) V', and a centred row times v / (s / sqrt(n)) is white. Working on R instead of R'R
keeps all digits of the small components.

Only exact sums, one R and the 16 components reach the driver; their size depends on the dimension alone. Rows stream
through the components; a vector that a third of all rows have is one row of the fit list, counted before the shuffle.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped; vectors of another length
than most (the shortest of equally many) are dropped too, as no covariance holds both; rows with one vec_id, without
vec_id or with equal vectors each give their rows; a component whose singular value is zero to double precision has
explained 0 and whitened null, and counts for nothing in identity_error; if no two vectors differ, explained is null; an
empty table, or one without a usable vector, gives an empty result; a deviation beyond 64 bits is null; entries of
2**56 or more in size are clipped there; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .shared import persisted

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Triangles merged at once, and rows of a block that a triangle takes in.
FAN, BLOCK = 16, 2048
_SAFE, _LARGEST = 1 << 62, (1 << 63) - 1


@dataclass
class Whitener:
    """n and exact sums of the fit list, right vectors as columns, singular values of the centred rows."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    singular: np.ndarray

    @property
    def explained(self) -> list[float | None]:
        total = float((self.singular**2).sum())
        return [float(x * x) / total if total else None for x in self.singular[: self.vectors.shape[1]]]

    @property
    def scaled(self) -> np.ndarray:
        """Right vectors over the roots of their eigenvalues; NaN where those are zero."""
        some = self.singular[: self.vectors.shape[1]]
        return self.vectors * np.where(some > 0, np.sqrt(self.n) / np.where(some > 0, some, 1), np.nan)


def quantised(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Usable rows with their vector as whole numbers x = floor(64 * c) + 1000000, in place of the column."""
    c = F.col(f"`{column}`")
    usable = rows.filter(c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = float(1 << 56)
    whole = F.transform(c, lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(most)), F.lit(-most)) * SCALE).cast("long") + SHIFT)
    usable = usable.withColumn(column, whole)
    sizes = usable.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return usable.join(F.broadcast(sizes.select("d")), F.size(c) == F.col("d")).drop("d").filter(F.size(c) > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values, _ = vec.lists(column)
    return np.asarray(values, np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: longs while they fit, Python's integers beyond."""
    if n * max([1, *(abs(int(v)) for v in (x.min(), x.max()))]) + max(map(abs, sums)) < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            fits = len(x) * int(np.abs(x).max()) < _SAFE
            own = [int(v) for v in (x if fits else x.astype(object)).sum(0)]
            n, total = n + len(x), own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    if total:
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(map(str, total), size=len(total))], ["dim", "n", "total"])


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    """R of rows on top of each other."""
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _packed(r: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r, np.float64).tobytes()], pa.binary())], ["part", "r"])


def _unpacked(r: bytes, d: int) -> np.ndarray:
    return np.frombuffer(r).reshape(-1, d)


def _factor(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, any_rows = np.zeros((0, len(sums))), False
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(k, BLOCK))
                r, any_rows = triangle([r, (_centred(x, n, sums) / n).astype(np.float64)]), True
        if any_rows:
            yield _packed(r, TaskContext.get().partitionId())

    return run


def _merge(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; those of one part make one triangle."""
        part, r = None, None
        for batch in batches:
            for own, data in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist(), strict=True):
                if part is not None and own != part:
                    yield _packed(r, part)
                    r = None
                part, r = own, _unpacked(data, d) if r is None else triangle([r, _unpacked(data, d)])
        if part is not None:
            yield _packed(r, part)

    return run


def merged(triangles: DataFrame, d: int) -> np.ndarray:
    """The one R of all triangles (part, r): FAN neighbours at a time become one until one is left."""
    triangles = persisted(triangles)
    most = triangles.agg(F.max("part")).first()[0]
    while most > 0:
        most //= FAN
        grouped = triangles.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).repartition(most + 1, "part").sortWithinPartitions("part", "r")
        triangles = persisted(grouped.mapInArrow(_merge(d), "part long, r binary"))
    return _unpacked(triangles.first()["r"], d)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Of one column of distinct vectors of whole numbers and of one length; None if there are none."""
    kind = "dim int, n long, total string"
    sums = vectors.mapInArrow(_sums, kind).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    if not sums:
        return None
    n, totals = sums[0]["n"], [int(r["total"]) for r in sorted(sums, key=lambda r: r["dim"])]
    r = merged(vectors.mapInArrow(_factor(n, totals), "part long, r binary"), len(totals))
    _, singular, right = np.linalg.svd(r, full_matrices=True)
    singular = np.concatenate([singular, np.zeros(len(totals) - len(singular))])
    singular[singular <= singular[0] * np.finfo(float).eps * max(n, len(totals))] = 0
    right = right[:components].T.copy()
    return Whitener(n, totals, right * np.where(right[np.abs(right).argmax(0), range(right.shape[1])] < 0, -1, 1), singular)


def _whitened(x: np.ndarray, model: Whitener) -> np.ndarray:
    return (_centred(x, model.n, model.sums) / model.n).astype(np.float64) @ model.scaled


def _products(model: Whitener, means: np.ndarray | None):
    """Sums over a partition of the whitened rows, or of the products of their entries less ``means``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                w = _whitened(_matrix(batch.column(0)), model)
                total = total + (w.sum(0)[None, :] if means is None else (w - means).T @ (w - means))
        if not np.isscalar(total):
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.record_batch([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""

    def summed(means: np.ndarray | None) -> np.ndarray:
        rows = vectors.mapInArrow(_products(model, means), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
        out = np.zeros((1 + max(r["i"] for r in rows), 1 + max(r["j"] for r in rows)))
        for r in rows:
            out[r["i"], r["j"]] = r["total"]
        return out

    covariance = summed(summed(None)[0] / model.n) / model.n
    off = np.abs(covariance - np.eye(len(covariance)))
    return float(np.nanmax(off)) if not np.isnan(off).all() else 0.0


def _applied(model: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            off = _centred(x, model.n, model.sums)
            far = (off.astype(np.float64) ** 2).sum(1).max() >= float(_SAFE) or off.dtype == object
            deviation = ((off.astype(object) if far else off) ** 2).sum(1).tolist()
            white = _whitened(x, model)
            flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
            bounds = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
            yield pa.record_batch([batch.column("row"), pa.array([v if v <= _LARGEST else None for v in deviation], pa.int64()), pa.ListArray.from_arrays(bounds, flat)], ["row", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The row as a struct ``row``, deviation, whitened (an array), and what the fit list has in common: n, explained (an
    array) and identity_error."""
    known = quantised(rows.select(F.struct("*").alias("row"), F.col(f"`{column}`").alias("x")), "x")
    row_kind = known.schema["row"].dataType.simpleString()
    kind = f"row {row_kind}, deviation long, whitened array<double>"
    vectors = persisted(known.select("x").distinct())
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{kind}, n long, explained array<double>, identity_error double")
    explained = F.array(*[F.lit(v).cast("double") for v in model.explained])
    out = known.mapInArrow(_applied(model), kind)
    return out.select("*", F.lit(model.n).cast("long").alias("n"), explained.alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = rows.select(F.col("row.vec_id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("k")].alias("explained"), "identity_error")
