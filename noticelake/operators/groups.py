"""Vectors grouped around pivots on two levels, with bounds on the cosine between a query and a whole group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.operators import tiles
from noticelake.session import staged

#: Pivots are learned from at most this many vectors, one for each hash bucket; all vectors are grouped.
SAMPLE = 4096
#: Rows a group holds on average, as far as the sample gives enough pivots.
GROUP_ROWS = 1024
#: Points that one task meets, of one or of many groups.
PART_ROWS = 1 << 17
FIT_ROUNDS = 4


@dataclass
class Rings:
    """Of each group that holds rows: its number, its rows, its pivot, its outer pivot, and the smallest and
    largest angle of its rows from each."""

    grp: np.ndarray
    size: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    angles: np.ndarray

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of unit rows to the groups' pivots, and the highest cosine that a row of each group can reach.

        On the sphere, a query at angle t from a pivot is at least max(t - high, low - t) away from a row
        whose angle from it lies in [low, high]. Both pivots of a group bound it.
        """
        to_inner = np.clip(unit @ self.inner.T, -1, 1)
        gap = np.zeros(to_inner.shape)
        for cos, low, high in ((to_inner, 0, 1), (np.clip(unit @ self.outer.T, -1, 1), 2, 3)):
            angle = np.arccos(cos)
            gap = np.maximum(gap, np.maximum(angle - self.angles[:, high], self.angles[:, low] - angle))
        return to_inner, np.cos(np.minimum(gap, np.pi))

    def nearest(self, unit: np.ndarray, k: int) -> np.ndarray:
        """For each unit row, a mark on the groups of the nearest pivots that hold ``k`` rows together."""
        order = np.argsort(-np.clip(unit @ self.inner.T, -1, 1), axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        taken = np.zeros(order.shape, bool)
        np.put_along_axis(taken, order, before < k, axis=1)
        return taken

    def parts(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each group's first part and how many parts it is cut into. Neighbouring groups share a part of
        about ``rows`` rows; a larger group has its own."""
        pieces = -(-self.size // rows)
        first, part, filled = np.zeros(len(self.grp), np.int64), 0, 0
        for g, (n, cut) in enumerate(zip(self.size, pieces)):
            if filled and filled + n > rows:
                part, filled = part + 1, 0
            first[g] = part
            filled += n
            if cut > 1:
                part, filled = part + cut, 0
        return first, pieces


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit pivots of unit rows, by a few rounds of spherical k-means from rows spread over them."""
    p = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = (x @ p.T).argmax(1)
        for c in range(len(p)):
            if (near == c).any():
                p[c] = tiles.unit_rows(x[near == c].sum(0, keepdims=True))[0]
    return p


def learn_pivots(sample: np.ndarray, wanted: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outer pivots, and for each its inner pivots, ``wanted`` or so in all."""
    outer = _fit(sample, max(1, round(wanted**0.5)))
    near = (sample @ outer.T).argmax(1)
    inner = []
    for c in range(len(outer)):
        own = sample[near == c]
        inner.append(_fit(own, max(1, round(wanted * len(own) / len(sample)))) if len(own) else outer[c : c + 1])
    return outer, inner


def _least_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hash bucket the row with the lowest hash ``h``, with the ``n`` of all its rows."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        h = rows.column("h").to_numpy()
        order = np.lexsort((h, h % SAMPLE))
        _, first = np.unique((h % SAMPLE)[order], return_index=True)
        n = np.add.reduceat(rows.column("n").to_numpy()[order], first) if len(first) else np.zeros(0, np.int64)
        kept = rows.take(pa.array(order[first]))
        held = pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(n)], schema=batch.schema)
    if held is not None:
        yield held


def group_points(points: DataFrame, keep: list[str], group_rows: int = GROUP_ROWS) -> tuple[DataFrame, Rings] | None:
    """``(grp, *keep, embedding)`` of rows with a vector, grouped around pivots learned from them, and the
    groups' rings; None if there are no rows.

    The number of groups grows with the rows. Rows look for their nearest outer pivot first and then
    only among its inner ones. The grouped rows are written once: bounds only hold if every pass sees a
    row in the same group.
    """
    # Buckets are reduced inside each task: as an aggregation of vectors, Spark would sort all of them.
    hashed = points.select("embedding", F.xxhash64("embedding").alias("h"), F.lit(1).cast("long").alias("n"))
    found = hashed.mapInArrow(_least_of_buckets, hashed.schema).groupBy(F.pmod("h", F.lit(SAMPLE)).alias("bucket")).agg(
        F.min_by("embedding", "h").alias("embedding"), F.sum("n").alias("n")
    ).orderBy("bucket").toPandas()
    if found.empty:
        return None
    wanted = max(1, min(len(found) // 2, -(-int(found["n"].sum()) // group_rows)))
    outer, inner = learn_pivots(tiles.unit_rows(tiles.matrix(found["embedding"])), wanted)
    first = np.r_[0, np.cumsum([len(p) for p in inner])]

    @F.pandas_udf("struct<grp:int,angle:double,outer_angle:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        x = tiles.unit_rows(tiles.matrix(v))
        cos = x @ outer.T
        near = cos.argmax(axis=1)
        grp, best = np.zeros(len(x), np.int32), np.zeros(len(x))
        for c in np.unique(near):
            own = np.flatnonzero(near == c)
            there = x[own] @ inner[c].T
            grp[own], best[own] = first[c] + there.argmax(axis=1), there.max(axis=1)
        angle = lambda a: np.arccos(np.clip(a, -1, 1))
        return pd.DataFrame({"grp": grp, "angle": angle(best), "outer_angle": angle(cos[np.arange(len(x)), near])})

    placed = staged(points.select(*keep, "embedding", assign("embedding").alias("a")).select(
        "a.grp", *keep, "embedding", F.col("a.angle").alias("_angle"), F.col("a.outer_angle").alias("_outer_angle")
    ), "grouped-points")
    # One row for each group: bounded by the sample.
    ends = [f(c) for c in ("_angle", "_outer_angle") for f in (F.min, F.max)]
    stats = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"r{k}") for k, e in enumerate(ends)]).toPandas().sort_values("grp")
    grp = stats["grp"].to_numpy()
    of = np.searchsorted(first, grp, "right") - 1
    rings = Rings(grp, stats["n"].to_numpy(), np.concatenate(inner)[grp], outer[of], stats[["r0", "r1", "r2", "r3"]].to_numpy())
    return placed.drop("_angle", "_outer_angle"), rings
