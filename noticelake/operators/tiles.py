"""Joins evaluated tile by tile.

A many-to-many join on a key with a hot value would put that key's whole left and right side into
one task. Here each key's rows are hashed into blocks of bounded size, every left block of a key
meets every right block of that key in a tile of its own, and a tile hands on only what survives
its own reduction. Keys of ordinary size make exactly one tile and are not replicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from noticelake.functions.vector import RANK_DIGITS
from noticelake.session import staged

LEFT_BLOCK = 8192
RIGHT_BLOCK = 8192
# More than rounding to RANK_DIGITS can move a score.
ROUNDING = 10.0**-RANK_DIGITS
# What a task holds at once: queries of a block, scores kept for them, cells of a slice, rows of a sent batch.
QUERY_BLOCK = 1 << 17
HELD = 1 << 22
CELLS = 1 << 22
# Cells worked out in single precision at a time; they stay in a core's own cache.
ROUGH = 1 << 18
SENT = 1 << 14
MARGIN = 1e-6
POINTS = 1 << 12


def tile_sizes(
    left: DataFrame, right: DataFrame, key: list[str], left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK
) -> DataFrame:
    """Blocks per key: ``(key, _lb, _rb)``, one row for each key of ``left``.

    ``left`` may be any table with at least as many rows per key as the one joined later.
    """
    count = lambda df, size, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))
    sizes = count(left, left_block, "_lb").join(count(right, right_block, "_rb"), key, "left")
    return sizes.withColumn("_rb", F.coalesce("_rb", F.lit(1)))


def tile_join(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    left_id: list[str],
    right_id: list[str],
    fn: Callable[[pa.Table, pa.Table], dict | None],
    schema: str,
    left_block: int = LEFT_BLOCK,
    right_block: int = RIGHT_BLOCK,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``fn(left block, right block)`` for every pair of blocks that share ``key``; ``fn`` returns the
    columns of its rows, or None for no rows.

    A left row whose key has no right rows still reaches ``fn`` once, with an empty right block.
    ``sizes`` is the result of :func:`tile_sizes` if the caller has it; ``left`` may carry its columns
    already, which saves a shuffle of wide rows by key.
    """
    if sizes is None:
        sizes = tile_sizes(left, right, key, left_block, right_block)
    sized = left if "_lb" in left.columns else left.join(sizes, key)
    block = lambda ids, n: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lhs = (
        sized.withColumn("_l", block(left_id, "_lb"))
        .withColumn("_r", spread("_rb"))
        .drop("_lb", "_rb")
    )
    rhs = (
        right.join(sizes, key)
        .withColumn("_r", block(right_id, "_rb"))
        .withColumn("_l", spread("_lb"))
        .drop("_lb", "_rb")
    )
    tile = [*key, "_l", "_r"]

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = fn(a, b) if a.num_rows else None
        return shape.empty_table() if out is None else pa.Table.from_pydict(out, schema=shape)

    # Both sides may come from the same table; fresh names keep their columns apart.
    rhs = rhs.select(*[F.col(c).alias(c) for c in rhs.columns])
    return lhs.groupBy(*tile).cogroup(rhs.groupBy(*tile)).applyInArrow(run, schema)


def stream_join(
    sent: DataFrame, points: DataFrame, start: Callable[[pa.Table], Callable], schema: str
) -> DataFrame:
    """Queries of a tile beside the points that pass by.

    ``sent`` holds ``_tile``, ``_vector``, the groups ``wants`` and what ``start`` reads, ``points`` holds
    ``_tile``, ``grp`` and its own columns. ``start(queries of a tile)`` returns ``meet(points of one group,
    rows of the queries that want it)``, which yields columns of rows. Only the queries and a batch are held.
    """
    own = [c for c in sent.columns if c not in ("_tile", "wants")]
    theirs = [c for c in points.columns if c not in ("_tile", "grp")]
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # Rows of both sides in one stream; the names of points step aside.
    lhs = sent.select("_tile", F.lit(None).cast("int").alias("grp"), "wants", *own, *(empty(points, c).alias(f"p_{c}") for c in theirs))
    rhs = points.select("_tile", "grp", empty(sent, "wants"), *(empty(sent, c) for c in own), *(F.col(c).alias(f"p_{c}") for c in theirs))
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, meet = None, [], None
        for whole in batches:
            tile, grp = (pc.fill_null(whole.column(c), -1).to_numpy() for c in ("_tile", "grp"))
            edges = np.flatnonzero((tile[1:] != tile[:-1]) | (grp[1:] != grp[:-1])) + 1
            for low, high in zip(np.r_[0, edges], np.r_[edges, len(tile)]) if len(tile) else ():
                if tile[low] != here:
                    here, asked, meet = tile[low], [], None
                if grp[low] < 0:
                    asked.append(whole.slice(low, high - low).select(["wants", *own]))
                    continue
                if not asked:
                    continue
                if meet is None:
                    held = pa.Table.from_batches(asked).combine_chunks()
                    groups, marks = _marks(held.column("wants"))
                    meet = start(held.drop_columns(["wants"]))
                at = np.searchsorted(groups, grp[low])
                rows = np.flatnonzero(marks[:, at]) if at < len(groups) and groups[at] == grp[low] else []
                for to in range(low, high if len(rows) else low, POINTS):
                    cut = whole.slice(to, min(POINTS, high - to)).select([f"p_{c}" for c in theirs])
                    for out in meet(pa.RecordBatch.from_arrays(cut.columns, names=theirs), rows):
                        yield pa.RecordBatch.from_pydict(out, schema=shape)

    return lhs.unionByName(rhs).repartition("_tile").sortWithinPartitions("_tile", F.asc_nulls_first("grp")).mapInArrow(run, schema)


def _marks(wants: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that any row wants, in order, and for each row a mark on those it wants."""
    lists = wants.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    groups, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    marks = np.zeros((len(lists), len(groups)), bool)
    marks[np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), at] = True
    return groups, marks


def spread_join(left: DataFrame, right: DataFrame, key: list[str], left_id: list[str], right_id: list[str], block: int = LEFT_BLOCK) -> DataFrame:
    """An inner equi-join whose hot keys are split: both sides' rows of a key are cut into blocks, and a task
    joins one block with one block. Keys that fill one block are joined as they are."""
    count = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    sizes = staged(count(left, "_lb").join(count(right, "_rb"), key), "join-sizes")
    part = lambda ids, n: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lhs = left.join(sizes, key).withColumn("_l", part(left_id, "_lb")).withColumn("_r", every("_rb")).drop("_lb", "_rb")
    rhs = right.join(sizes, key).withColumn("_r", part(right_id, "_rb")).withColumn("_l", every("_lb")).drop("_lb", "_rb")
    return lhs.join(rhs, [*key, "_l", "_r"]).drop("_l", "_r")


def vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that have a vector, and their vectors as a float64 matrix."""
    held = column.drop_null()
    where = np.flatnonzero(column.is_valid().to_numpy())
    flat = pc.list_flatten(held).to_numpy().astype(np.float64)
    return where, flat.reshape(len(held), -1) if len(held) else np.zeros((0, 0))


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A numeric column as floats; missing and zero become NaN."""
    values = column.cast(pa.float64()).to_numpy().copy()
    values[~np.isfinite(values) | (values == 0)] = np.nan
    return values


def names(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct lower-case names, and for each row the position of its name among them."""
    coded = pc.utf8_lower(pc.fill_null(column, "")).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def pick(column: pa.ChunkedArray, rows: np.ndarray) -> pa.Array:
    taken = column.take(pa.array(rows, pa.int64()))
    return taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken


def matrix(vectors) -> np.ndarray:
    """Vectors of a pandas column as a float64 matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def cosines(a: pa.Table, b: pa.Table, left: str = "embedding", right: str = "embedding"):
    """Rows of ``a`` and ``b`` that have a vector, and the cosines between them."""
    rows, mine = vectors(a.column(left))
    cols, theirs = vectors(b.column(right))
    if not len(rows) or not len(cols):
        return rows, cols, np.zeros((len(rows), len(cols)))
    return rows, cols, unit_rows(mine) @ unit_rows(theirs).T


def flat(column) -> np.ndarray:
    """Vectors of an Arrow list column without nulls as a float64 matrix."""
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_flatten(column).to_numpy()
    return values.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sliced_cosines(a: pa.Table, b: pa.Table, left: str = "embedding", right: str = "embedding"):
    """Rows of ``a`` and ``b`` that have a vector, and ``(at, cosines)`` of a few rows from ``at`` on at a time."""
    rows, mine = vectors(a.column(left))
    cols, theirs = vectors(b.column(right))
    if not len(rows) or not len(cols):
        return rows, cols, iter(())
    mine, theirs = unit_rows(mine), unit_rows(theirs)
    step = max(1, CELLS // len(cols))
    return rows, cols, ((at, mine[at : at + step] @ theirs.T) for at in range(0, len(rows), step))


def cells_above(unit: np.ndarray, rows: np.ndarray, block: np.ndarray, bar: np.ndarray):
    """``(row, col, cosine)`` of the cells of ``unit[rows]`` and ``block`` that reach the row's ``bar``, some rows at a time.

    Single precision tells which cells may, by more than it can be off; those are worked out in double.
    """
    if not len(rows) or not len(block):
        return
    slack = unit.shape[1] * 2.0**-22 + MARGIN
    rough = block.astype(np.float32).T
    step = max(1, CELLS // len(block))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        mine = unit[own]
        lean, least = mine.astype(np.float32), (bar[own] - slack).astype(np.float32)[:, None]
        few = max(1, ROUGH // len(block))
        near = np.concatenate([low * len(block) + np.flatnonzero(lean[low : low + few] @ rough >= least[low : low + few]) for low in range(0, len(own), few)])
        row, col = np.divmod(near, len(block))
        if not len(row):
            continue
        if len(row) * 64 > len(own) * len(block):
            score = (mine @ block.T)[row, col]
        else:
            score = np.einsum("ij,ij->i", mine[row], block[col])
        good = score >= bar[own[row]] - ROUNDING
        if good.any():
            yield own[row[good]], col[good], score[good]


def top_cells(score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of each row's best ``k`` scores, compared at ``RANK_DIGITS`` decimals;
    ties go to the lower ``ident``. Only cells near a row's k-th score are rounded and sorted."""
    keep = min(k, score.shape[1])
    cut = np.partition(score, score.shape[1] - keep, axis=1)[:, -keep][:, None]
    row, col = np.nonzero(score >= cut - ROUNDING)
    pos = best_k(row, np.round(score[row, col], RANK_DIGITS), ident[col], k)
    return row[pos], col[pos]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length stay zero, so their cosine is 0."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_k(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's ``k`` best entries by score (descending), then id."""
    order = np.lexsort((ident, -score, owner))
    owners = owner[order]
    first = np.r_[True, owners[1:] != owners[:-1]] if len(owners) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(owners)) - np.repeat(starts, np.diff(np.r_[starts, len(owners)]))
    return order[rank < k]
