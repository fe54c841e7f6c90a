"""k-means in exact integers, with a LAESA pivot table.

Every kept vector's distances to a few fixed pivots are stored once, beside its integer components. In each round the
triangle inequality bounds a vector's distance to every centroid from below by the largest difference of their pivot distances;
only centroids whose bound does not exceed the best distance so far get the exact integer distance. Bounds are floats with
a slack above their rounding error, so no centroid is ruled out that could win or tie.

Kept are vectors of exactly SIZE components, none null or not finite; each becomes floor(256 * x). Components beyond LIMIT
are held at it: distances of larger ones fit no long. Repeated vec_ids are vectors of their own; a null vec_id comes last
in the order of hashes, equal hashes are ordered by their components. With fewer kept vectors than centroids each vector is one.
Without kept vectors the result is empty. An inertia that fits no long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import lean, stored

SIZE = 64
PIVOTS = 8
LIMIT = 1 << 27  # squares of differences of SIZE such components add up to less than 2**63
BLOCK = 4096  # vectors whose bounds a task holds at once


def kept(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """vec_id and the integer components of the vectors of a batch that are kept."""
    column = batch.column("embedding")
    rows = np.flatnonzero((np.diff(column.offsets.to_numpy()) == SIZE) & column.is_valid().to_numpy(zero_copy_only=False))
    first = column.offsets.to_numpy()[rows]
    values = column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = values[first[:, None] + np.arange(SIZE)] if len(rows) else np.zeros((0, SIZE))
    fine = np.isfinite(x).all(1)
    x = np.clip(np.floor(256.0 * x[fine]), -LIMIT, LIMIT).astype(np.int32)
    return batch.column("vec_id").take(pa.array(rows[fine])), x


def packed_rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, x = kept(batch)
        # big-endian with the sign bit turned, so that the order of the bytes is that of the components
        yield pa.RecordBatch.from_arrays([ids, packed_rows((x.astype(np.uint32) ^ np.uint32(1 << 31)).astype(">u4"))], ["vec_id", "x"])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances, as floats, of each row of x to each of the points."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in points], 1).astype(np.float64)) if len(points) else np.zeros((len(x), 0))


def chosen_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n of the centroids, each the one farthest from those before it."""
    picked = [0]
    far = ((centroids - centroids[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((centroids - centroids[picked[-1]]) ** 2).sum(1))
    return centroids[picked]


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest centroid (of equal ones the first), its squared distance, and how many exact distances it took in all."""
    ours = distances(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - ours[None, :, p]), out=bound)
    bound -= 1e-12 * (to_pivots.max(initial=0) + ours.max(initial=0)) + 1e-9
    best = bound.argmin(1)
    least = ((x - centroids[best]) ** 2).sum(1)
    first, taken = best.copy(), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= np.sqrt(least.astype(np.float64))) & (first != c))
        taken += len(rows)
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        rows = rows[better]
        least[rows], best[rows] = d[better], c
    return best, least, taken


def _with_pivots(pivots) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = kept(batch)
            yield pa.RecordBatch.from_arrays([ids, packed_rows(x), packed_rows(distances(x.astype(np.int64), pivots.value))], ["vec_id", "x", "to_pivots"])

    return lean(run)


def _blocks(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """vec_id, components, nearest centroid and squared distance, block by block."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            x = unpacked(part.column("x"), np.int32, SIZE).astype(np.int64)
            best, least, _ = nearest(x, unpacked(part.column("to_pivots"), np.float64, len(model["pivots"])), model["centroids"], model["pivots"])
            yield part.column("vec_id"), x, best, least


def _sums(shared) -> Callable:
    """A task's count and componentwise sums of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total, n = np.zeros_like(model["centroids"]), np.zeros(len(model["centroids"]), np.int64)
        for _, x, best, _ in _blocks(batches, model):
            np.add.at(total, best, x)
            n += np.bincount(best, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), *(pa.array(total[some, k]) for k in range(SIZE))], ["cluster", "n", *_columns()])

    return lean(run)


def _assigned(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, best, least in _blocks(batches, shared.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(least)], ["vec_id", "cluster", "distance"])

    return lean(run)


def _columns() -> list[str]:
    return [f"s{k}" for k in range(SIZE)]


def clustered(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.mapInArrow(_integers, "vec_id long, x binary").orderBy(draw.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.stack([(np.frombuffer(r.x, ">u4").astype(np.uint32) ^ np.uint32(1 << 31)).astype(np.int32).astype(np.int64) for r in first])
    pivots = chosen_pivots(centroids)
    table = stored(rows.mapInArrow(_with_pivots(spark.sparkContext.broadcast(pivots)), "vec_id long, x binary, to_pivots binary"), "pivot_table")

    sums = "cluster int, n long, " + ", ".join(f"{c} long" for c in _columns())
    for _ in range(rounds):
        model = spark.sparkContext.broadcast({"centroids": centroids, "pivots": pivots})
        found = table.mapInArrow(_sums(model), sums).groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ["n", *_columns()])).collect()  # a row a cluster
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [r[c] // r.n for c in _columns()]
        model.unpersist()

    model = spark.sparkContext.broadcast({"centroids": centroids, "pivots": pivots})
    out = stored(table.mapInArrow(_assigned(model), "vec_id long, cluster int, distance long"), "clustered")
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.expr("sum(cast(distance as decimal(38, 0)))").alias("s")).collect()}
    whole = sum(int(v) for v in inertia.values())
    fits = lambda v: int(v) if v < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, fits(v), fits(whole), digest(c)) for c, v in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
