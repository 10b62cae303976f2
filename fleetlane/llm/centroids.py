"""Centroid clustering with Elkan's bounds, in whole numbers (operator 11).

Vectors with exactly `components` components, none null or not finite, are kept, each component x as floor(scale * x).
The first centroids are the `k` kept vectors with the smallest SHA-256 of `seed:<vec_id>`. Each round gives every vector to
its nearest centroid (squared distance; of equal ones the smaller number), then moves every centroid that has vectors
to their mean, rounded down component by component; at last vectors are given out once more.

A vector carries an upper bound of the distance to its centroid and a lower bound of that to each one, from round to
round: when centroids have moved, the bounds move as far. A distance is calculated only where the bounds, and half the
distance between two centroids, leave it open. A calculation is skipped only where the other centroid is farther for
certain: bounds are rounded outwards, comparisons are strict, so equal distances are always calculated, in integers.

Vectors and bounds are packed in blocks, which a round reads and writes anew, with the block's sums; sums are added up
by centroid and component. Only centroids, k * components numbers, pass the driver.

Vectors that aren't kept get no row, nor do those with a component beyond 2^27 after scaling, as squares of distances
must fit in a long. Fewer than k vectors: as many centroids. Rows with equal vec_id are vectors of their own; a null
vec_id is never a first centroid. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK, LARGEST = 4096, 1 << 27
STATE = "ids binary, vectors binary, width int, cluster binary, upper binary, lower binary, distance binary, sums array<long>, counts array<long>, calculated long"


def _up(x: np.ndarray) -> np.ndarray:
    """As float32, no smaller."""
    return np.nextafter((x * (1 + 2.0**-40)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """As float32, no larger, and not under 0."""
    return np.maximum(np.nextafter((x * (1 - 2.0**-40)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Bounds:
    """The assignment of a block's vectors, and bounds of their distances. At first all belong to centroid 0."""

    def __init__(self, vectors: np.ndarray, k: int, cluster=None, upper=None, lower=None):
        n = len(vectors)
        self.vectors = vectors
        self.cluster = np.zeros(n, np.int32) if cluster is None else cluster
        self.upper = np.full(n, np.inf, np.float32) if upper is None else upper
        self.lower = np.zeros((n, k), np.float32) if lower is None else lower
        self.exact, self.known = np.zeros(n, np.int64), np.zeros(n, bool)
        self.calculated = 0

    def moved(self, by: np.ndarray) -> None:
        """Centroids moved so far."""
        self.upper = _up(self.upper.astype(np.float64) + by[self.cluster])
        self.lower = _down(self.lower.astype(np.float64) - by)

    def _calculate(self, rows: np.ndarray, j: int, centroids: np.ndarray) -> np.ndarray:
        d = squared(self.vectors[rows], centroids[j])
        self.lower[rows, j] = _down(np.sqrt(d.astype(np.float64)))
        self.calculated += len(rows)
        return d

    def tighten(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        """Exact distances of these vectors to their own centroids."""
        rows = rows[~self.known[rows]]
        for j in np.unique(self.cluster[rows]):
            of = rows[self.cluster[rows] == j]
            self.exact[of] = self._calculate(of, j, centroids)
            self.upper[of] = _up(np.sqrt(self.exact[of].astype(np.float64)))
            self.known[of] = True

    def assign(self, centroids: np.ndarray) -> None:
        between = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64))
        half = _down(between / 2)
        nearest = half.copy()
        np.fill_diagonal(nearest, np.inf)
        open_rows = np.flatnonzero(self.upper >= nearest.min(axis=1)[self.cluster])
        for j in range(len(centroids)):
            doubtful = lambda rows: rows[(self.cluster[rows] != j) & (self.upper[rows] >= self.lower[rows, j]) & (self.upper[rows] >= half[self.cluster[rows], j])]  # noqa: E731, B023
            rows = doubtful(open_rows)
            self.tighten(rows, centroids)
            rows = doubtful(rows)
            d = self._calculate(rows, j, centroids)
            own = self.exact[rows]
            wins = (d < own) | ((d == own) & (j < self.cluster[rows]))
            won = rows[wins]
            self.cluster[won], self.exact[won] = j, d[wins]
            self.upper[won] = _up(np.sqrt(d[wins].astype(np.float64)))


def _packed(vectors: np.ndarray) -> tuple[bytes, int]:
    """A block's vectors in as few bytes a component as hold them all, and how many these are."""
    most = int(np.abs(vectors).max(initial=0))
    width = 2 if most < 1 << 15 else 4
    return vectors.astype(f"<i{width}").tobytes(), width


def _kept(table: DataFrame, components: int, scale: int) -> DataFrame:
    """vec_id and v (whole numbers) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda y: F.floor(y * F.lit(float(scale))))
    usable = (F.size(x) == components) & F.forall(x, lambda y: F.coalesce(F.abs(y) * scale <= LARGEST - 1, F.lit(False)) & ~F.isnan(y))
    return table.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<int>").alias("v"))


def _first(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    named = kept.filter("vec_id is not null").withColumn("name", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("name", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def _state(ids: bytes, b: Bounds, k: int) -> list:
    packed, width = _packed(b.vectors)
    counts = np.bincount(b.cluster, minlength=k)
    sums = np.zeros((k, b.vectors.shape[1]), np.int64)
    for j in np.flatnonzero(counts):
        sums[j] = b.vectors[b.cluster == j].sum(axis=0, dtype=np.int64)
    return [ids, packed, width, *(x.tobytes() for x in (b.cluster, b.upper, b.lower, b.exact)), sums.ravel().tolist(), counts.tolist(), b.calculated]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    names = [x.split()[0] for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _begun(kept: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """Blocks of vectors, given to their centroids for the first time."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = pa.array([-1 if x is None else x for x in part.column(0).to_pylist()], pa.int64()).to_numpy()
                known = np.array([x.is_valid for x in part.column(0)], np.int64)
                b = Bounds(part.column(1).flatten().to_numpy().reshape(-1, size), k)
                b.assign(centroids)
                if last:
                    b.tighten(np.arange(len(b.cluster)), centroids)
                yield _batch([_state(np.stack([ids, known]).astype("<i8").tobytes(), b, k)])

    return kept.mapInArrow(run, STATE)


def _bounds(row: dict, size: int, k: int) -> Bounds:
    vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, size)
    of = lambda name, kind: np.frombuffer(row[name], kind).copy()
    return Bounds(vectors, k, of("cluster", np.int32), of("upper", np.float32), of("lower", np.float32).reshape(-1, k))


def _round(blocks: DataFrame, before: np.ndarray, centroids: np.ndarray, last: bool) -> DataFrame:
    k, size = centroids.shape
    by = _up(np.sqrt(np.array([int(((a - b) ** 2).sum()) for a, b in zip(before, centroids, strict=True)], np.float64))).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _bounds(row, size, k)
                b.moved(by)
                b.assign(centroids)
                if last:
                    b.tighten(np.arange(len(b.cluster)), centroids)
                yield _batch([_state(row["ids"], b, k)])

    return blocks.select(*[x.split()[0] for x in STATE.split(", ")]).mapInArrow(run, STATE)


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the blocks' vectors; those without vectors stay."""
    k, size = centroids.shape
    numbers = blocks.select(F.posexplode(F.concat("sums", "counts")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = {r["i"]: r["x"] for r in numbers.collect()}  # k * (size + 1) rows
    counts = [total[k * size + j] for j in range(k)]
    return np.array([[total[j * size + c] // counts[j] for c in range(size)] if counts[j] else centroids[j] for j in range(k)], np.int64)


def clustered(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (its components) of the kept vectors of
    a table (vec_id, embedding)."""
    kept = _kept(table, components, scale)
    centroids = _first(kept, k, seed)
    if not len(centroids):
        spark = table.sparkSession
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    blocks = stored(_begun(kept, centroids, not rounds), "blocks")
    for n in range(1, rounds + 1):
        before, centroids = centroids, _means(blocks, centroids)
        was, blocks = blocks, stored(_round(blocks, before, centroids, n == rounds), "blocks")
        discard(was, shuffles=False)
    return _rows(blocks, centroids)


def _rows(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
                arrays = [pa.array(ids, mask=known == 0), pa.array(np.frombuffer(row["cluster"], np.int32)), pa.array(np.frombuffer(row["distance"], np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    rows = blocks.select("ids", "cluster", "distance").mapInArrow(run, "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: r["x"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows
    about = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), c.tolist()) for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digests(table: DataFrame) -> DataFrame:
    out = clustered(table)
    name = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", name.alias("centroid_sha256"))
