"""Centroid clustering in whole numbers, with distances pruned in a rotated space.

Vectors are cut to integers once. An orthogonal rotation onto the principal axes of a written table's covariance is applied to them once too, and of each
rotated vector only the leading coordinates and the length of the rest are stored. For a vector v and a centroid c with leading coordinates p and
rests r, |v - c|^2 >= |p(v) - p(c)|^2 + (r(v) - r(c))^2. Each round takes this bound for all centroids, computes the integer distance of the one
with the least bound, and verifies in integers only those centroids whose bound isn't above it. The bound is lowered by more than floating-point
numbers can be off, so results don't depend on the rotation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, only, written

#: Integers of a vector lie below this, so that a squared distance of MOST_DIMENSIONS of them fits 64 bits.
LIMIT = 1 << 27
MOST_DIMENSIONS = 256
#: Rows that a task works on at once.
BLOCK = 4096


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def integers(vectors: DataFrame, *, dimensions: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array<long>): floor(scale * x) of the vectors of exactly `dimensions` components, none null, not finite, or out of +-LIMIT once scaled."""
    x = F.transform("x", lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LIMIT, F.lit(False)))  # false for NaN: it is above all numbers
    rows = only(vectors, id_col, vector_col).toDF("id", "x").where((F.size("x") == dimensions) & fine)
    return rows.select(F.col("id").cast("long").alias("id"), x.alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `<salt>:<id>`, in that order; rows of one id in the order of their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(key, "v").limit(k).collect()], np.int64)  # k rows


def principal_axes(rows: DataFrame, dimensions: int) -> np.ndarray:
    """Orthonormal axes of all vectors, by falling variance. Each task sends sums of products, a matrix of dimensions^2 numbers; they are added up by rows of it."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for block in _blocks(batches):
            x = np.ones((block.num_rows, dimensions + 1))
            x[:, 1:] = _matrix(block.column(0), "float64")
            total += x.T @ x
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions + 1), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *names])

    names = [f"m{j}" for j in range(dimensions + 1)]
    sums = rows.select("v").mapInArrow(moments, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    m = np.zeros((dimensions + 1, dimensions + 1))
    for row in sums.collect():  # dimensions + 1 rows
        m[row[0]] = row[1:]
    mean = m[0, 1:] / max(m[0, 0], 1.0)
    cov = m[1:, 1:] / max(m[0, 0], 1.0) - np.outer(mean, mean)
    axes = np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1]
    return np.linalg.qr(axes)[0]


def _projected(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the length of the others."""
    y = x.astype(np.float64) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))


def stored(rows: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """rows with p (leading rotated coordinates) and rest (length of the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            p, rest = _projected(_matrix(block.column(1), "int64"), axes, leading)
            offsets = pa.array(np.arange(0, leading * len(p) + 1, leading), pa.int32())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.ListArray.from_arrays(offsets, pa.array(p.ravel())), pa.array(rest)], names=["id", "v", "p", "rest"])

    return rows.mapInArrow(run, "id long, v array<long>, p array<double>, rest double")


def nearest(v: np.ndarray, p: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each vector's nearest centroid (of equal ones the smallest), the squared distance, and how many distances were computed in integers."""
    cp, crest = _projected(centroids, axes, p.shape[1])
    norms, cnorms = (p * p).sum(1) + rest * rest, (cp * cp).sum(1) + crest * crest
    bound = norms[:, None] + cnorms[None, :] - 2 * (p @ cp.T) - 2 * rest[:, None] * crest[None, :]
    bound -= 1e-9 * (norms[:, None] + cnorms[None, :]) + 1e-6
    exact = lambda i, j: ((v[i] - centroids[j]) ** 2).sum(1)
    every = np.arange(len(v))
    likely = bound.argmin(1)
    known = exact(every, likely)
    i, j = np.nonzero((bound <= known[:, None]) & (np.arange(len(centroids))[None, :] != likely[:, None]))
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[every, likely] = known
    for at in range(0, len(i), BLOCK * 4):
        a, b = i[at : at + BLOCK * 4], j[at : at + BLOCK * 4]
        distance[a, b] = exact(a, b)
    best = distance.argmin(1)
    return best, distance[every, best], len(v) + len(i)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for block in _blocks(batches):
        v = _matrix(block.column(1), "int64")
        yield block, v, *nearest(v, _matrix(block.column(2), "float64"), block.column(3).to_numpy(), centroids, axes)[:2]


def moved(rows: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means of what is assigned to each; those of nothing stay. A task sends a row per centroid."""
    names = [f"s{j}" for j in range(centroids.shape[1])]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, v, cluster, _ in _assigned(batches, centroids, axes):
            n += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(c) for c in total[some].T)], names=["cluster", "n", *names])

    parts = rows.mapInArrow(sums, "cluster long, n long, " + ", ".join(f"{c} long" for c in names))
    exact = lambda c: F.sum(F.col(c).cast(T.DecimalType(20, 0))).alias(c)
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[exact(c) for c in names]).collect():  # a row per centroid
        out[row.cluster] = [int(s) // row.n for s in row[2:]]
    return out


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2", leading: int = 32, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector: see `integers` for which are kept.

    Centroids start as the k kept vectors of smallest sha256 of `<salt>:<id>` (all of them if there are fewer; none give an empty result), and each of `rounds` rounds assigns and moves them.
    Ties go to the smaller number. A row gives a row, whether ids and vectors repeat or not; a null id counts as an empty text in the hash. Other columns are
    left aside. cluster_inertia and inertia are distances summed over the vector's cluster and over all.
    """
    if not 0 < dimensions <= MOST_DIMENSIONS or k < 1:
        raise ValueError(f"dimensions must be in 1..{MOST_DIMENSIONS}, k above 0")
    cut = written(integers(vectors, dimensions=dimensions, scale=scale, id_col=id_col, vector_col=vector_col), "integers")
    centroids = first_centroids(cut, k, salt)
    schema = "id long, cluster int, distance long"
    if len(centroids):
        axes = principal_axes(cut, dimensions)
        rows = written(stored(cut, axes, min(leading, dimensions)), "rotated")
        for _ in range(rounds):
            centroids = moved(rows, centroids, axes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, found, distance in _assigned(batches, centroids, axes):
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

        final = written(rows.mapInArrow(assign, schema), "assigned")
        dropped(rows)
    else:
        final = vectors.sparkSession.createDataFrame([], schema)
    dropped(cut)
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row per centroid
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    named = each.crossJoin(whole).join(vectors.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string"), "cluster")  # one row of totals
    out = final.join(F.broadcast(named), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
