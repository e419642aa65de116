"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it, and the keys are sorted. A cell
is a run of up to ``CELL`` vectors of one pivot; inside it, annuli of ``ANNULUS`` vectors are the
unit that a bound rules out. For a query q at distance d of the pivot, a vector x in the ring
[lo, hi] is at least gap = max(0, d - hi, lo - d) away, so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2
is at most (|q|^2 + m - gap^2) / 2 with m the ring's largest |x|^2. A query first searches the cell
that it lies in, annulus by annulus outwards, which gives it a k-th score; then it visits the cells
whose bound reaches that score, and stops within each at the first annulus whose bound does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from noticelake.llm.common import cut
from noticelake.llm.int_vectors import whole_vectors

CELL, ANNULUS, CHUNK = 4096, 256, 8192
FIT_ROWS, PIVOTS, FIT_ROUNDS = 4096, 256, 5
#: Stand for a missing score and, in packed cells, for a null id.
NONE, NULL_ID = -np.iinfo(np.int64).max, np.iinfo(np.int64).min

STORED = "rid long, vec_id long, v array<int>, dim int, asks boolean, pivot int, dist double"
CELLS = "cell long, dim int, pivot int, lo double, hi double, most double, n int, vec_ids binary, rids binary, asks binary, dists binary, data binary"
ASKED = "rid long, vec_id long, dim int, q binary, norm2 double, kth long, cell long, to_pivots array<double>, top_ids array<long>, top_rids array<long>, top_scores array<long>, looked long"
FOUND = "rid long, vec_id long, top_ids array<long>, top_rids array<long>, top_scores array<long>, looked long"


def top_products(
    rows: DataFrame, asks: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row where ``asks`` holds, the ``k`` highest inner products with other rows.

    Components become ``floor(scale * x)`` and scores are whole. Ties go to the smaller ``vec_id``, a
    null one last. A row is left out against itself only: a repeated row is another candidate, and a
    repeated query row returns its own ``k``. Vectors that are null, or hold a null, NaN, infinite or
    outsized (2**25 or more after scaling) component take no part; a query meets candidates of its
    own number of components, and one that meets none has no rows. An empty table gives none.

    The pivots are fitted on the ``FIT_ROWS`` vectors of smallest hash; every vector is indexed.
    """
    found = searched(rows, asks, k, scale, id_col, vector_col, pivots)
    hits = found.select("rid", F.col("vec_id").alias("query_id"), F.inline(F.arrays_zip(F.col("top_ids").alias("vec_id"), F.col("top_rids").alias("other"), F.col("top_scores").alias("score"))))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(rows, asks, k, scale, id_col, vector_col, pivots) -> DataFrame:
    """Each query's best of each visited cell, with how many vectors it was compared with there."""
    kept = whole_vectors(rows, id_col, vector_col, scale, F.coalesce(asks, F.lit(False)).alias("asks")).withColumn("dim", F.size("v"))
    centres = fitted(kept, pivots)
    # Row numbers hold from here on: the rows are read from the written checkpoint.
    stored = cut(kept.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_keyed(centres), STORED))
    cells = cut(
        stored.repartitionByRange("dim", "pivot", "dist", F.xxhash64("rid")).sortWithinPartitions("dim", "pivot", "dist", "rid")
        .withColumn("part", F.spark_partition_id()).mapInArrow(_cells, CELLS)
    )
    asked = cut(cells.mapInArrow(_own_cell(centres, k), ASKED))
    chunks = max(1, -(-asked.count() // CHUNK))
    return asked.select("rid", "vec_id", "top_ids", "top_rids", "top_scores", "looked").union(
        _visited(asked, cells, chunks, k).select("rid", "vec_id", "top_ids", "top_rids", "top_scores", "looked")
    )


def fitted(kept: DataFrame, pivots: int | None) -> dict[int, np.ndarray]:
    """Pivots by number of components: a few rounds of k-means on the ``FIT_ROWS`` vectors of smallest hash.

    A number of components that the sample does not hold has the origin as its only pivot.
    """
    n = kept.count()
    wanted = pivots or min(PIVOTS, max(1, int(n ** 0.5) // 4))
    sample: dict[int, list] = {}
    for row in kept.where("dim > 0").select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).collect():
        sample.setdefault(row.dim, []).append(row.v)
    centres = {}
    for dim, rows in sample.items():
        x = np.unique(np.array(rows, np.float64), axis=0)
        p = x[np.linspace(0, len(x) - 1, min(wanted, len(x))).astype(int)]
        for _ in range(FIT_ROUNDS):
            near = _squares(x, p).argmin(1)
            for c in range(len(p)):
                if (near == c).any():
                    p[c] = x[near == c].mean(0)
        centres[dim] = p
    return centres


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0.0)


def _keyed(centres: dict[int, np.ndarray]):
    """Nearest pivot and distance of every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                d = _squares(x, centres.get(int(dim), np.zeros((1, dim))))
                pivot[at] = d.argmin(1)
                dist[at] = np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vec_id"), batch.column("v"), batch.column("dim"), batch.column("asks"), pa.array(pivot), pa.array(dist)],
                ["rid", "vec_id", "v", "dim", "asks", "pivot", "dist"],
            )

    return run


def _cells(batches: Iterator[pa.RecordBatch]):
    """Sorted rows cut into cells: up to ``CELL`` rows of one pivot, fewer where vectors are very long."""
    held, serial = None, 0

    def close(h):
        nonlocal serial
        ids, rids, asks, dists, data = (np.concatenate([x[j] for x in h["rows"]]) for j in range(5))
        whole = data.reshape(len(rids), h["dim"]).astype(np.float64)
        cell = (h["part"] << 32) | serial
        serial += 1
        row = [cell, h["dim"], h["pivot"], float(dists[0]), float(dists[-1]), float((whole * whole).sum(1).max()), len(rids),
               ids.tobytes(), rids.tobytes(), asks.tobytes(), dists.tobytes(), data.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CELL_TYPES)], _CELL_NAMES)

    for batch in batches:
        dims, pivots = batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()
        ids = batch.column("vec_id").fill_null(NULL_ID).to_numpy()
        rids, asks, dists = batch.column("rid").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False), batch.column("dist").to_numpy()
        starts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (pivots[1:] != pivots[:-1])]) if len(dims) else []
        for a, b in zip(starts, [*starts[1:], len(dims)]):
            dim, pivot = int(dims[a]), int(pivots[a])
            while a < b:
                if held and (held["dim"], held["pivot"]) != (dim, pivot) or held and held["n"] >= held["most"]:
                    yield close(held)
                    held = None
                if held is None:
                    held = {"dim": dim, "pivot": pivot, "part": int(batch.column("part")[int(a)].as_py()), "rows": [], "n": 0, "most": max(1, min(CELL, (CELL * 256) // max(1, dim)))}
                m = int(min(b - a, held["most"] - held["n"]))
                data = batch.column("v").slice(int(a), m).flatten().to_numpy(zero_copy_only=False)
                held["rows"].append((ids[a:a + m], rids[a:a + m], asks[a:a + m], dists[a:a + m], data))
                held["n"] += m
                a += m
    if held:
        yield close(held)


_CELL_NAMES = ["cell", "dim", "pivot", "lo", "hi", "most", "n", "vec_ids", "rids", "asks", "dists", "data"]
_CELL_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 5]


class Cell:
    """One cell's vectors, ids and annuli."""

    def __init__(self, row: dict):
        self.dim, self.pivot = row["dim"], row["pivot"]
        self.ids, self.rids = np.frombuffer(row["vec_ids"], np.int64), np.frombuffer(row["rids"], np.int64)
        self.asks, self.dists = np.frombuffer(row["asks"], np.bool_), np.frombuffer(row["dists"], np.float64)
        self.data = np.frombuffer(row["data"], np.int32).reshape(len(self.rids), self.dim)
        self.norms = (self.data.astype(np.float64) ** 2).sum(1)
        starts = np.arange(0, len(self.rids), ANNULUS)
        self.bounds = np.r_[starts, len(self.rids)]
        self.lo, self.hi = self.dists[starts], self.dists[self.bounds[1:] - 1]
        self.most = np.maximum.reduceat(self.norms, starts)
        # Products of floats are whole and exact up to 2**53; beyond, longs are used.
        self.large = float(np.abs(self.data).max(initial=0))

    def products(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.large * float(np.abs(q).max(initial=0)) * max(1, self.dim) < 2.0 ** 53:
            return (q.astype(np.float64) @ self.data[a:b].T.astype(np.float64)).astype(np.int64)
        return q.astype(np.int64) @ self.data[a:b].T.astype(np.int64)

    def search(self, q: np.ndarray, rids: np.ndarray, norm2: np.ndarray, d: np.ndarray, kth: np.ndarray, k: int):
        """Best ``k`` of this cell for each query row, of scores at or over ``kth``: scores, places (-1: none) and vectors looked at.

        Step t takes each query to its t-th best annulus; a query stops at the first whose bound is under its k-th score.
        """
        n = len(q)
        best, place, looked = np.full((n, k), NONE), np.full((n, k), -1), np.zeros(n, np.int64)
        limit = kth.copy()
        bound = upper(norm2[:, None], self.most, d[:, None], self.lo, self.hi)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(n)
        for step in range(order.shape[1]):
            at = order[live, step]
            near = bound[live, at] >= limit[live]
            live, at = live[near], at[near]
            if not len(live):
                break
            for ring in np.unique(at):
                who = live[at == ring]
                a, b = self.bounds[ring], self.bounds[ring + 1]
                scores = self.products(q[who], a, b)
                scores[self.rids[a:b] == rids[who][:, None]] = NONE
                looked[who] += b - a
                joined = np.concatenate([best[who], scores], axis=1)
                places = np.concatenate([place[who], np.broadcast_to(np.arange(a, b), scores.shape)], axis=1)
                keep = self._first(joined, places, k)
                best[who], place[who] = np.take_along_axis(joined, keep, 1), np.take_along_axis(places, keep, 1)
                limit[who] = np.maximum(limit[who], best[who, k - 1])
        place[(best < kth[:, None]) | (best == NONE)] = -1
        return best, place, looked

    def _first(self, scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """Columns of each row's best ``k``: by score down, then id up (null last), then row number."""
        if scores.shape[1] > k:
            # Ties at the k-th score stay in, so that ids decide among them.
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            width = int((scores >= least).sum(1).max())
            some = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        else:
            some = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        s, p = np.take_along_axis(scores, some, 1), np.take_along_axis(places, some, 1)
        ids = np.where(p < 0, np.iinfo(np.int64).max, self.ids[p])
        ids = np.where(ids == NULL_ID, np.iinfo(np.int64).max, ids)
        by = np.lexsort((self.rids[p], ids, -s), axis=1)[:, :k]
        return np.take_along_axis(some, by, 1)


def upper(norm2, most, d, lo, hi):
    """No product of a query of squared norm ``norm2``, ``d`` away from the pivot, with a vector of the ring passes this."""
    gap = np.maximum(np.maximum(d - hi, lo - d), 0.0)
    slack = 1e-9 * (norm2 + most + d * d + hi * hi) + 1e-6
    return np.minimum((norm2 + most - gap * gap) / 2, np.sqrt(norm2 * most)) + slack


def _lists(cell: Cell, best: np.ndarray, place: np.ndarray):
    """Arrow lists of ids (null again), row numbers and scores of the places met."""
    met = place >= 0
    ends = pa.array(np.r_[0, np.cumsum(met.sum(1))].astype(np.int32))
    at = place[met]
    ids = cell.ids[at]
    return [pa.ListArray.from_arrays(ends, x) for x in (pa.array(ids, mask=ids == NULL_ID), pa.array(cell.rids[at]), pa.array(best[met]))]


def _own_cell(centres: dict[int, np.ndarray], k: int):
    """Each query's best of the cell it lies in, its k-th score there and its distances from all pivots."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                cell = Cell(row)
                p = centres.get(cell.dim, np.zeros((1, cell.dim)))
                for some in np.array_split(np.flatnonzero(cell.asks), max(1, -(-int(cell.asks.sum()) // 256))):
                    if not len(some):
                        continue
                    q, rids = cell.data[some], cell.rids[some]
                    best, place, looked = cell.search(q, rids, cell.norms[some], cell.dists[some], np.full(len(some), NONE), k)
                    away = np.sqrt(_squares(q.astype(np.float64), p))
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(p))
                    ids = cell.ids[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids), pa.array(ids, mask=ids == NULL_ID), pa.array(np.full(len(some), cell.dim, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()),
                         pa.array(cell.norms[some]), pa.array(best[:, k - 1]), pa.array(np.full(len(some), row["cell"])), pa.ListArray.from_arrays(ends, pa.array(away.ravel())),
                         *_lists(cell, best, place), pa.array(looked)],
                        ["rid", "vec_id", "dim", "q", "norm2", "kth", "cell", "to_pivots", "top_ids", "top_rids", "top_scores", "looked"],
                    )

    return run


def _visited(asked: DataFrame, cells: DataFrame, chunks: int, k: int) -> DataFrame:
    """Best of every other cell whose bound reaches the query's k-th score.

    Queries meet the narrow list of cells by pivot, in chunks so that no key holds more than ``CHUNK``
    queries or so; then a task streams the queries of one chunk past one cell.
    """
    chunk = F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")
    rings = cells.select("cell", "dim", "pivot", "lo", "hi", "most").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    ways = asked.select("rid", "dim", "norm2", "kth", F.col("cell").alias("own"), chunk.alias("chunk"), F.posexplode("to_pivots").alias("pivot", "d"))
    gap = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0))
    slack = F.lit(1e-9) * (F.col("norm2") + F.col("most") + F.col("d") * F.col("d") + F.col("hi") * F.col("hi")) + F.lit(1e-6)
    bound = F.least((F.col("norm2") + F.col("most") - gap * gap) / 2, F.sqrt(F.col("norm2") * F.col("most"))) + slack
    visits = ways.join(rings, ["dim", "pivot", "chunk"]).where((F.col("cell") != F.col("own")) & (bound >= F.col("kth"))).select("rid", "cell", "chunk", "d")
    with_query = visits.join(asked.select("rid", "vec_id", "q", "norm2", "kth"), "rid").select(
        "cell", "chunk", F.lit(1).alias("kind"), "rid", "vec_id", "q", "norm2", "kth", "d", F.lit(None).cast("struct<dim:int,pivot:int,vec_ids:binary,rids:binary,asks:binary,dists:binary,data:binary>").alias("held")
    )
    held = F.struct("dim", "pivot", "vec_ids", "rids", "asks", "dists", "data").alias("held")
    none = lambda kind: F.lit(None).cast(kind)
    with_cell = cells.join(visits.select("cell", "chunk").distinct(), "cell").select(
        "cell", "chunk", F.lit(0).alias("kind"), none("long").alias("rid"), none("long").alias("vec_id"), none("binary").alias("q"),
        none("double").alias("norm2"), none("long").alias("kth"), none("double").alias("d"), held,
    )
    # Hash partitioning by cell and chunk, then each task reads a cell before its queries.
    return with_cell.union(with_query).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind", "rid").mapInArrow(_visit(k), FOUND)


def _visit(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        cell, key = None, None
        for batch in batches:
            cells, chunks, kinds = (batch.column(c).to_numpy() for c in ("cell", "chunk", "kind"))
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])]) if len(cells) else []
            for a, b in zip(starts, [*starts[1:], len(cells)]):
                if kinds[a] == 0:
                    cell, key = Cell(batch.column("held")[int(a)].as_py()), (cells[a], chunks[a])
                    continue
                assert key == (cells[a], chunks[a])
                for at in range(int(a), int(b), 256):
                    m = min(256, int(b) - at)
                    take = lambda c: batch.column(c).slice(at, m)
                    q = np.frombuffer(b"".join(take("q").to_pylist()), np.int32).reshape(m, cell.dim)
                    best, place, looked = cell.search(q, take("rid").to_numpy(), take("norm2").to_numpy(), take("d").to_numpy(), take("kth").to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([take("rid"), take("vec_id"), *_lists(cell, best, place), pa.array(looked)], ["rid", "vec_id", "top_ids", "top_rids", "top_scores", "looked"])

    return run
