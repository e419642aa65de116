"""Centroid clustering in whole numbers, with centroids ruled out by PCA-rotated distances.

Every vector is stored once with its leading rotated coordinates and the norm of what they leave
out. The squared distance of the coordinates plus the squared difference of the two norms never
exceeds the squared distance, so a centroid whose bound passes the best one found is not looked at;
the others are compared in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import cut
from noticelake.llm.int_vectors import matrix, whole_vectors

LEADING = 16


def cluster_vectors(
    rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding", leading: int = LEADING,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector.

    Kept are vectors of ``dim`` components, none null, NaN or infinite; a component is
    ``floor(scale * x)``. One of 2**25 or more in size cannot be squared and summed exactly in a
    long, so such a vector is left out as well. The first centroids are the ``k`` kept vectors with
    the smallest sha256 of ``<seed>:<vec_id>`` (equal ids by vector, a null id as empty text); fewer
    vectors make fewer centroids. Rows are never merged: a repeated row counts and returns as often
    as it stands. Ties go to the smaller centroid number, an empty centroid stays where it is. An
    empty table gives no rows; other columns are ignored.
    """
    kept = whole_vectors(rows, id_col, vector_col, scale).where(F.size("v") == dim)
    mean, basis = rotation(kept, dim, leading)
    stored = cut(kept.mapInArrow(_rotate(mean, basis, dim), "vec_id long, v array<int>, y array<double>, r double"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.v for r in stored.orderBy(name, "v").select("v").limit(k).collect()], np.int64).reshape(-1, dim)
    for _ in range(rounds):
        centroids = _moved(stored, centroids, mean, basis)
    out = cut(stored.mapInArrow(_assign(centroids, mean, basis), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shas = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist()] or [F.lit("")])
    sums = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))] or [F.lit(0).cast("long")])
    at = F.col("cluster") + 1
    return out.select(
        "vec_id", "cluster", "distance", F.element_at(sums, at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(shas, at).alias("centroid_sha256"),
    )


def rotation(kept: DataFrame, dim: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``leading`` principal axes of all vectors; ``dim`` squared numbers reach the driver.

    Any orthonormal axes bound rightly, so the order of float sums cannot change a result.
    """
    def moments(batches: Iterator[pa.RecordBatch]):
        total, products, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for batch in batches:
            x = matrix(batch.column("v"), dim).astype(np.float64)
            total, products, n = total + x.sum(0), products + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], total, products.ravel()])], pa.list_(pa.float64()))], ["m"])

    sums = kept.select("v").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + dim + dim * dim)
    for row in sums:
        flat[row.k] = row.x
    n = max(flat[0], 1.0)
    mean = flat[1:dim + 1] / n
    cov = flat[dim + 1:].reshape(dim, dim) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh((cov + cov.T) / 2)
    return mean, axes[:, ::-1][:, :leading]


def rotated(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of each row and the norm of the rest."""
    x = x - mean
    y = x @ basis
    return y, np.sqrt(np.maximum((x * x).sum(1) - (y * y).sum(1), 0.0))


def _rotate(mean, basis, dim):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            y, r = rotated(matrix(batch.column("v"), dim), mean, basis)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(y.ravel())), pa.array(r)], ["vec_id", "v", "y", "r"]
            )

    return run


def nearest(v: np.ndarray, y: np.ndarray, r: np.ndarray, centroids: np.ndarray, cy: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances were worked out.

    Centroids are taken in the order of their bounds; a row is done once its next bound passes its best distance.
    """
    bound = np.maximum((y * y).sum(1)[:, None] + (cy * cy).sum(1) - 2 * (y @ cy.T), 0.0) + (r[:, None] - cr) ** 2
    # Rounding errors of the floats are far below this share of the summed squares.
    size = (y * y).sum(1)[:, None] + (cy * cy).sum(1) + (r * r)[:, None] + cr * cr
    bound -= 1e-9 * size + 1e-6
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(v), np.iinfo(np.int64).max)
    number = np.zeros(len(v), np.int32)
    live, looked = np.arange(len(v)), 0
    for step in range(len(centroids)):
        c = order[live, step]
        near = bound[live, c] <= best[live]
        live, c = live[near], c[near]
        if not len(live):
            break
        gap = v[live] - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < best[live]) | ((d == best[live]) & (c < number[live]))
        best[live[better]], number[live[better]] = d[better], c[better]
        looked += len(live)
    return number, best, looked


def _batches(batches, centroids, mean, basis):
    cy, cr = rotated(centroids, mean, basis)
    for batch in batches:
        if batch.num_rows:
            v = matrix(batch.column("v"), centroids.shape[1]).astype(np.int64)
            number, best, _ = nearest(v, matrix(batch.column("y"), basis.shape[1]), batch.column("r").to_numpy(), centroids, cy, cr)
            yield batch, v, number, best


def _assign(centroids, mean, basis):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch, _, number, best in _batches(batches, centroids, mean, basis):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def _moved(stored: DataFrame, centroids: np.ndarray, mean, basis) -> np.ndarray:
    """Each centroid at the rounded-down mean of its vectors; a task hands on one sum for each centroid."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]):
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, v, number, _ in _batches(batches, centroids, mean, basis):
            np.add.at(total, number, v)
            n += np.bincount(number, minlength=k)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    if not k:
        return centroids
    added = stored.mapInArrow(sums, "cluster int, n long, total array<long>").groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dim)]
    )
    centroids = centroids.copy()
    for row in added.collect():
        centroids[row.cluster] = [int(row[f"t{i}"]) // row.n for i in range(dim)]
    return centroids
