"""Embedding providers, exact top-k cosine search, centroids and counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions import text as tx, vector as vx
from noticelake.operators import groups, tiles
from noticelake.operators.ingest import upsert
from noticelake.session import staged

# A query set is broadcast only when it has at most this many vector elements (8 MiB of doubles).
BROADCAST_ELEMENTS = 1024 * 1024
# Texts whose words a task of the hash provider holds at once.
HASHED_ROWS = 500
# Texts that a task hands to a model at once.
EMBEDDED_ROWS = 500
# Payload keys that sit beside the metadata rather than inside it.
TOP_LEVEL_KEYS = ("page", "document_id", "firm_id", "notice_id", "buyer_name", "value", "region")


# ---- embedding -----------------------------------------------------------------------------------


def embed_lookup(rows: DataFrame, key: str, vectors: DataFrame, vector_key: str = "vec_id") -> DataFrame:
    """Stored vectors as the provider: rows without one get null."""
    stored = vectors.select(F.col(vector_key).alias(key), F.col("embedding"))
    return rows.join(stored, key, "left")


def embed_hash(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Deterministic provider: signed md5 buckets of lower-case words, scaled to length one.

    A row's words are folded to ``dim`` sums inside its task, so no word is shuffled; rows of one key are
    added up. Texts without words have no row.
    """
    kind = dict(rows.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_ROWS):
                part = batch.slice(at, HASHED_ROWS)
                lists = pc.split_pattern(part.column(1), " ")
                ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
                coded = lists.flatten().dictionary_encode()
                # Each different word of the slice is hashed once.
                words = coded.dictionary.cast(pa.binary()).to_pylist()
                made = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in words]), np.uint8).reshape(-1, 16).astype(np.int64)
                slot = (made[:, 0] << 16 | made[:, 1] << 8 | made[:, 2]) % dim
                sign = np.where(made[:, 15] & 15 < 8, 1, -1)
                sign[[i for i, w in enumerate(words) if not w]] = 0
                word = coded.indices.to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
                cell = owner * dim + slot[word]
                sums = np.bincount(cell, sign[word], part.num_rows * dim).astype(np.int32)
                held = np.flatnonzero(np.bincount(owner, sign[word] != 0, part.num_rows))
                sums = pa.array(sums.reshape(-1, dim)[held].ravel())
                starts = pa.array(np.arange(len(held) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(held)), pa.ListArray.from_arrays(starts, sums)], names=[key, "_sums"])

    plain = rows.select(key, F.lower(tx.squeeze(text)).alias("_text")).where("_text <> ''")
    folded = plain.mapInArrow(fold, f"`{key}` {kind}, _sums array<int>")
    total = folded.groupBy(key).agg(*[F.sum(F.col("_sums")[i]).alias(f"_s{i}") for i in range(dim)])
    filled = total.select(key, F.array(*[F.col(f"_s{i}").cast("double") for i in range(dim)]).alias("raw"))
    length = vx.norm("raw")
    scaled = tx.let(length, lambda n: F.when(n == 0, F.col("raw")).otherwise(F.transform("raw", lambda x: x / n)))
    return filled.select(key, scaled.cast("array<float>").alias("embedding"))


def embed_model(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[pd.Series], Iterable]]) -> DataFrame:
    """The user's model as provider: ``(key, embedding, error)``, one row for each row.

    ``load`` runs once in each task and returns a function from a batch of texts to their vectors in
    order, so a model is set up once for many batches of at most ``EMBEDDED_ROWS`` texts. A batch that fails is tried text by text; a
    text that fails then, or whose vector is missing or not finite, gets a null ``embedding`` and its
    ``error``. Null texts are not sent to the model.
    """
    def one(model, value) -> tuple:
        try:
            vector = np.asarray(list(model(pd.Series([value])))[0], dtype=np.float64)
        except Exception as e:  # a model may fail in any way; its row is kept with the reason
            return None, f"{type(e).__name__}: {e}"
        return (vector, None) if vector.ndim == 1 and np.isfinite(vector).all() else (None, "not a finite vector")

    def made_of(model, texts: pd.Series) -> list[tuple]:
        given = texts[texts.notna()]
        try:
            made = [np.asarray(v, dtype=np.float64) for v in model(given)]
            good = len(made) == len(given) and all(v.ndim == 1 and np.isfinite(v).all() for v in made)
        except Exception:  # which text it was shows text by text
            good = False
        found = [(v, None) for v in made] if good else [one(model, t) for t in given]
        by_row = dict(zip(given.index, found))
        return [by_row.get(i, (None, "no text")) for i in texts.index]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED_ROWS):
                part = batch.slice(at, EMBEDDED_ROWS)
                rows = made_of(model, pd.Series(part.column(1).to_pylist(), dtype=object))
                made = pa.array([None if v is None else v.astype(np.float32) for v, _ in rows], pa.list_(pa.float32()))
                said = pa.array([e for _, e in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), made, said], names=[key, "embedding", "error"])

    lean = rows.select(F.col(key), F.col(text).alias("_text"))
    return lean.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>, error string")


def embed_outcome(made: DataFrame) -> DataFrame:
    """Of a provider's rows: how many were asked for, how many have a vector, how many have none."""
    return made.agg(
        F.count(F.lit(1)).alias("total"), F.count("embedding").alias("success_count"),
        (F.count(F.lit(1)) - F.count("embedding")).alias("failed_count"),
    )


def embed_missing(
    rows: DataFrame, store: DataFrame, key: str, text: str, provider, vector_key: str = "vector_id"
) -> tuple[DataFrame, DataFrame]:
    """Embed only rows that have no vector id; returns the rows with ids written back, and the store."""
    todo = rows.where(F.col(vector_key).isNull())
    made = provider(todo, key, text).where(F.col("embedding").isNotNull())
    named = made.withColumn("_new_id", tx.md5_uuid(F.concat(F.lit("cap-"), F.col(key).cast("string"))))
    written = (
        rows.join(named.select(key, "_new_id"), key, "left")
        .withColumn(vector_key, F.coalesce(vector_key, "_new_id"))
        .drop("_new_id")
    )
    fresh = named.select(F.col("_new_id").alias(vector_key), "embedding", F.lit(1).alias("_seq"))
    return written, upsert(store, fresh, vector_key, "_seq")


# ---- filters and shapes --------------------------------------------------------------------------


def payload_filter(points: DataFrame, conditions: dict | None = None, document_type: str | None = None) -> DataFrame:
    """Equality conjunction: known keys at the top, any other inside ``metadata``."""
    wanted = [F.col("document_type") == document_type] if document_type else []
    for key, value in (conditions or {}).items():
        wanted.append(F.col(key if key in TOP_LEVEL_KEYS else f"metadata.{key}") == F.lit(value))
    for condition in wanted:
        points = points.where(condition)
    return points


def shape_hits(hits: DataFrame) -> DataFrame:
    """Uniform hit rows: columns of the other document type are null."""
    legal = F.col("document_type") == "legal_document"
    notice = F.col("document_type") == "contract_opportunity"
    only = lambda cond, c, default=None: F.when(
        cond, F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)
    ).alias(c)
    have = [c for c in ("query_id", "metadata", "score") if c in hits.columns]
    return hits.select(
        *have,
        "point_id",
        "content",
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        only(legal, "page", 1),
        only(legal, "document_id", ""),
        only(notice, "notice_id", ""),
        only(notice, "buyer_name", ""),
        only(notice, "value"),
        only(notice, "region"),
    )


def search_result_row(hits: DataFrame) -> DataFrame:
    """A hit with its metadata flattened into result columns."""
    optional = (
        "closing_time", "start_date", "end_date", "value_low", "value_high", "postcode", "notice_type",
        "contact_name", "contact_email", "contact_phone", "contact_address", "contact_website",
        "additional_text", "attachments", "links", "suitable_for_sme", "suitable_for_vco",
    )
    inner = set(hits.schema["metadata"].dataType.names)
    meta = lambda c: F.col(f"metadata.{c}") if c in inner else F.lit(None).cast("string")
    lead = [c for c in ("query_id",) if c in hits.columns]
    return hits.select(
        *lead,
        F.coalesce("notice_id", F.lit("")).alias("notice_id"),
        F.coalesce(meta("title"), F.lit("")).alias("title"),
        F.coalesce("buyer_name", F.lit("")).alias("buyer_name"),
        F.coalesce(meta("description"), meta("title")).alias("description"),
        "value",
        "region",
        meta("closing_date").alias("closing_date"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        *[meta(c).alias(c) for c in optional],
    )


# ---- top-k ---------------------------------------------------------------------------------------


def rank_top(scored: DataFrame, k: int, owner: str, ident: str, score: str = "score") -> DataFrame:
    """Best ``k`` rows per owner, with ``rank``. The filter sits directly on the window, so Spark
    limits each partition before it shuffles."""
    w = Window.partitionBy(owner).orderBy(F.desc(score), F.asc(ident))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _small_queries(queries: DataFrame, query_id: str, limit: int) -> pa.Table | None:
    """The query set as a local table if it has at most ``limit`` vector elements, else None."""
    dim = queries.select(F.size("embedding").alias("d")).limit(1).collect()
    if not dim:
        return queries.select(query_id, "embedding").limit(0).toArrow()
    most = max(1, limit // max(1, dim[0]["d"]))
    if queries.select(F.lit(1)).limit(most + 1).count() > most:
        return None
    return queries.select(query_id, "embedding").toArrow()


def vector_topk(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    query_id: str = "query_id",
    point_id: str = "point_id",
    broadcast_elements: int = BROADCAST_ELEMENTS,
) -> DataFrame:
    """Exact best ``k`` points per query by cosine: ``(query_id, point_id, score, rank)``.

    Scores are compared at ``RANK_DIGITS`` decimals, ties by point id. A query set proven small is
    broadcast and every scan task keeps only its own best ``k`` per query; a larger one goes through
    :func:`knn_join`. Points without a vector take no part.
    """
    points = points.where(F.col("embedding").isNotNull())
    queries = queries.where(F.col("embedding").isNotNull())
    small = _small_queries(queries, query_id, broadcast_elements)
    if small is None:
        return knn_join(queries, points, k, query_id, point_id)
    types = {**dict(queries.dtypes), **dict(points.dtypes)}
    schema = f"qno int, {point_id} {dict(points.dtypes)[point_id]}, score double"
    names = small.column(query_id)
    if small.num_rows == 0:
        empty = f"{query_id} {types[query_id]}, {point_id} {types[point_id]}, score double, rank int"
        return points.sparkSession.createDataFrame([], empty)
    sc = points.sparkSession.sparkContext
    unit = tiles.unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in small.column("embedding").to_pylist()]))
    shared = sc.broadcast(unit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        held: list[tuple] = []
        pending = 0
        floor = np.full(len(q), -np.inf)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            block = tiles.unit_rows(flat.reshape(batch.num_rows, -1))
            step = max(k, 4_000_000 // len(q))
            for at in range(0, len(block), step):
                score = q @ block[at : at + step].T
                bar = floor
                if score.shape[1] >= k and not np.isfinite(floor).all():
                    bar = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
                qno, row = np.nonzero(score >= (bar - tiles.ROUNDING)[:, None])
                ident = ids.take(pa.array(at + row)).to_numpy(zero_copy_only=False)
                held.append((qno, np.round(score[qno, row], vx.RANK_DIGITS), ident))
                pending += len(qno)
                if pending > 4 * k * len(q):
                    held, floor = _reduce(held, k, len(q))
                    pending = len(held[0][0])
        if held:
            (qno, score, ident), = _reduce(held, k, len(q))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qno, pa.int32()), pa.array(ident, batch.schema.field(0).type), pa.array(score, pa.float64())],
                names=["qno", point_id, "score"],
            )

    partial = points.select(point_id, "embedding").mapInArrow(scan, schema)
    ranked = rank_top(partial, k, "qno", point_id)
    # The map from query number to id has the broadcast size checked above.
    index = points.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(names.to_pylist())], f"qno int, {query_id} {types[query_id]}"
    )
    return ranked.join(F.broadcast(index), "qno").select(query_id, point_id, "score", "rank")


def _reduce(held: list[tuple], k: int, n: int):
    """Keep each query's best ``k`` held entries; also the score a new entry has to reach."""
    qno, score, ident = (np.concatenate([h[i] for h in held]) for i in range(3))
    best = tiles.best_k(qno, score, ident, k)
    qno, score, ident = qno[best], score[best], ident[best]
    floor = np.full(n, -np.inf)
    owners, counts = np.unique(qno, return_counts=True)
    full = owners[counts >= k]
    if len(full):
        worst = np.full(n, np.inf)
        np.minimum.at(worst, qno, score)
        floor[full] = worst[full]
    return [(qno, score, ident)], floor


# More than rounding can move a cosine worked out from angles.
MARGIN = 1e-7


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    query_id: str = "query_id",
    point_id: str = "point_id",
    block: int = tiles.RIGHT_BLOCK,
    group_rows: int = groups.GROUP_ROWS,
    part_rows: int = groups.PART_ROWS,
) -> DataFrame:
    """Exact k-nearest-neighbour join for query sets too large to broadcast.

    Points are grouped around pivots on two levels. Each query first meets only the groups nearest to
    it, which gives a score its final k-th hit is sure to reach; after that it meets just those other
    groups whose bound reaches that score. The first round joins groups with queries in tiles of bounded
    size. In the second a query may have to see most groups, so it goes once to each part of many groups
    with the list of those it wants, and a task holds a block of queries while the part's points pass by.
    """
    qtype, ptype = dict(queries.dtypes)[query_id], dict(points.dtypes)[point_id]
    out = f"{query_id} {qtype}, {point_id} {ptype}, score double"
    held = groups.group_points(points, [point_id], group_rows)
    if held is None:
        return points.sparkSession.createDataFrame([], out + ", rank int")
    placed, rings = held

    def best(a: pa.Table, b: pa.Table) -> dict | None:
        rows, cols, found = tiles.sliced_cosines(a, b)
        if not len(rows) or not len(cols):
            return None
        ident = tiles.pick(b.column(point_id), cols).to_numpy(zero_copy_only=False)
        row, col, score = (np.concatenate(p) for p in zip(*(
            (at + r, c, cos[r, c]) for at, cos in found for r, c in (tiles.top_cells(cos, ident, k),)
        )))
        return {
            query_id: tiles.pick(a.column(query_id), rows[row]),
            point_id: tiles.pick(b.column(point_id), cols[col]),
            "score": np.round(score, vx.RANK_DIGITS),
        }

    def start(asked: pa.Table) -> Callable:
        unit = tiles.unit_rows(tiles.flat(asked.column("_vector")))
        floor = asked.column("floor").to_numpy().copy()
        top = np.repeat(floor[:, None], k, axis=1)
        names = asked.column(query_id)

        def meet(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[dict]:
            ident = batch.column(point_id).to_numpy(zero_copy_only=False)
            for row, col, score in tiles.cells_above(unit, rows, tiles.unit_rows(tiles.flat(batch.column("embedding"))), floor):
                score = np.round(score, vx.RANK_DIGITS)
                kept = tiles.best_k(row, score, ident[col], k)
                row, col, score = row[kept], col[kept], score[kept]
                owner, at, n = np.unique(row, return_index=True, return_counts=True)
                # The k best scores seen so far raise what a later point has to reach.
                fresh = np.full((len(owner), k), -np.inf)
                fresh[np.repeat(np.arange(len(owner)), n), np.arange(len(row)) - np.repeat(at, n)] = score
                top[owner] = np.partition(np.hstack([top[owner], fresh]), k, axis=1)[:, k:]
                floor[owner] = top[owner].min(axis=1)
                yield {query_id: tiles.pick(names, row), point_id: batch.column(point_id).take(pa.array(col)), "score": score}

        return meet

    lean = staged(visits(
        queries.select(query_id, "embedding"), rings, {"near": "array<int>"}, lambda batch, unit: _listed_groups(rings, rings.nearest(unit, k))
    ), "knn-queries")
    first = tiles.tile_join(
        lean.select(query_id, "embedding", F.explode("near").alias("grp")), placed, ["grp"], [query_id], [point_id], best, out,
        left_block=block, right_block=block,
    )
    ranked = staged(rank_top(first, k, query_id, point_id), "knn-first")
    worst = F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor")
    floors = ranked.groupBy(query_id).agg(worst)

    def others(batch: pa.RecordBatch, unit: np.ndarray) -> np.ndarray:
        reached = rings.bounds(unit)[1] + MARGIN >= batch.column("floor").to_numpy()[:, None]
        near = batch.column("near")
        owner = np.repeat(np.arange(len(unit)), pc.list_value_length(near).to_numpy())
        reached[owner, np.searchsorted(rings.grp, near.flatten().to_numpy())] = False
        return reached

    second = _by_parts(lean.join(floors, query_id), placed, rings, query_id, point_id, others, start, out, part_rows, tiles.HELD // k)
    return rank_top(ranked.drop("rank").unionByName(second), k, query_id, point_id).select(query_id, point_id, "score", "rank")


def _listed_groups(rings: groups.Rings, marks: np.ndarray) -> tuple[np.ndarray, dict]:
    """One row for each query, with the numbers of its marked groups."""
    ends = np.r_[0, np.cumsum(marks.sum(axis=1))]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rings.grp[np.nonzero(marks)[1]], pa.int32()))
    return np.arange(len(marks)), {"near": lists}


#: Marks of groups a task works out at a time.
MARKS = 1 << 19


def visits(queries: DataFrame, rings: groups.Rings, more: dict[str, str], made, leave: tuple[str, ...] = ()) -> DataFrame:
    """The queries' rows with further columns, as ``made(batch, unit vectors)`` repeats and extends them:
    it returns row positions and the columns ``more`` (name to type) beside them. Columns to ``leave`` are read
    but not handed on. A task sees few queries at a time, however many groups there are."""
    step = max(1, MARKS // len(rings.grp))
    kept = [c for c in queries.columns if c not in leave]
    names = [*kept, *more]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, columns = made(batch, tiles.unit_rows(tiles.flat(batch.column("embedding"))))
                # Few rows go out at a time too: each carries its vector again.
                for to in range(0, len(row), tiles.SENT):
                    part = pa.array(row[to : to + tiles.SENT], pa.int64())
                    cut = [columns[c][to : to + tiles.SENT] for c in more]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(part) for c in kept), *cut], names=names)

    return queries.mapInArrow(send, ", ".join([*(f"`{c}` {t}" for c, t in queries.dtypes if c in kept), *(f"{c} {t}" for c, t in more.items())]))


def _by_parts(
    queries: DataFrame, placed: DataFrame, rings: groups.Rings, query_id: str, point_id: str, wanted, start: Callable, schema: str,
    part_rows: int, query_rows: int,
) -> DataFrame:
    """``start(queries)`` meets the points of the groups that ``wanted(batch, unit vectors)`` marks for each query.

    Groups are packed into parts of about ``part_rows`` points (a larger group is cut into several), queries
    are hashed into blocks of at most about ``query_rows``; a tile is one part beside one block. Points that
    no query of the block wants stay behind.
    """
    spark = placed.sparkSession
    first, pieces = rings.parts(part_rows)
    blocks = max(1, -(-queries.count() // max(1024, min(query_rows, tiles.QUERY_BLOCK))))

    def send(batch: pa.RecordBatch, unit: np.ndarray) -> tuple[np.ndarray, dict]:
        row, col = np.nonzero(wanted(batch, unit))
        n = pieces[col]
        row, col, at = np.repeat(row, n), np.repeat(col, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        part = first[col] + at
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.zeros(0, int)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(rings.grp[col], pa.int32()))
        return row[new], {"_part": pa.array(part[new], pa.int32()), "wants": lists}

    tile = lambda b: (F.col("_part") * blocks + b).cast("int").alias("_tile")
    keep = [c for c in queries.columns if c not in ("embedding", "near")]
    sent = visits(queries, rings, {"_part": "int", "wants": "array<int>"}, send, ("near",)).select(
        tile(F.pmod(F.xxhash64(query_id), F.lit(blocks))), *keep, F.col("embedding").alias("_vector"), "wants"
    )
    # One row for each group: bounded by the sample.
    where = spark.createDataFrame([tuple(map(int, r)) for r in zip(rings.grp, first, pieces)], "grp int, _first int, _pieces int")
    cut = F.col("_first") + F.pmod(F.xxhash64(point_id), F.col("_pieces")).cast("int")
    dealt = placed.join(F.broadcast(where), "grp").withColumn("_part", cut).drop("_first", "_pieces").withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).select(tile(F.col("_b")), *placed.columns)
    asked = sent.select("_tile", F.explode("wants").alias("grp")).distinct()
    return tiles.stream_join(sent, dealt.join(asked, ["_tile", "grp"], "left_semi"), start, schema)


def rows_above(
    queries: DataFrame, points: DataFrame, least: float, query_id: str, point_id: str, owner: str,
    block: int = tiles.QUERY_BLOCK, group_rows: int = groups.GROUP_ROWS, part_rows: int = groups.PART_ROWS,
) -> DataFrame:
    """``(query_id, owner)``, each once, for queries and owners of a point whose cosine with it is ``least`` or more.

    A query meets only the groups whose bound reaches ``least``; a batch of points hands on an owner once for a query.
    """
    types = {**dict(points.dtypes), **dict(queries.dtypes)}
    out = f"{query_id} {types[query_id]}, {owner} {types[owner]}"
    held = groups.group_points(points.where(F.col("embedding").isNotNull()), [point_id, owner], group_rows)
    if held is None:
        return points.sparkSession.createDataFrame([], out)
    placed, rings = held

    def start(asked: pa.Table) -> Callable:
        unit = tiles.unit_rows(tiles.flat(asked.column("_vector")))
        bar = np.full(len(unit), least)

        def meet(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[dict]:
            coded = batch.column(owner).dictionary_encode("encode")
            for row, col, _ in tiles.cells_above(unit, rows, tiles.unit_rows(tiles.flat(batch.column("embedding"))), bar):
                met = np.unique(np.stack([row, coded.indices.to_numpy()[col]]), axis=1)
                yield {query_id: tiles.pick(asked.column(query_id), met[0]), owner: coded.dictionary.take(pa.array(met[1]))}

        return meet

    # Counted, and read for the tiles and for the points they want.
    asked = staged(queries.where(F.col("embedding").isNotNull()).select(query_id, "embedding"), "asked-vectors")
    reached = lambda batch, unit: rings.bounds(unit)[1] + MARGIN >= least
    return _by_parts(asked, placed, rings, query_id, point_id, reached, start, out, part_rows, block).distinct()


def search_notices(
    queries: DataFrame,
    points: DataFrame,
    limit: int,
    region: str | None = None,
    min_value: float | None = None,
    max_value: float | None = None,
    range_mode: str = "post",
    conditions: dict | None = None,
) -> DataFrame:
    """Top ``limit`` notices per query. The value range is applied after the ranking (``post``), so
    fewer rows may come back, or before it (``pre``)."""
    wanted = dict(conditions or {}, **({"region": region} if region else {}))
    pool = payload_filter(points, wanted, "contract_opportunity")
    in_range = F.lit(True)
    if min_value is not None or max_value is not None:
        in_range = F.col("value").isNotNull()
        in_range = in_range & (F.col("value") >= min_value) if min_value is not None else in_range
        in_range = in_range & (F.col("value") <= max_value) if max_value is not None else in_range
    if range_mode == "pre":
        return vector_topk(queries, pool.where(in_range), limit)
    hits = vector_topk(queries, pool, limit)
    if min_value is None and max_value is None:
        return hits
    return hits.join(pool.where(in_range).select("point_id"), "point_id", "left_semi")


def with_points(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with their points' columns. Points are narrowed to those found before their texts are read or shuffled."""
    # Read for the ids and for the rows; written once, the search runs once.
    hits = staged(hits, "search-hits")
    found = points.join(hits.select("point_id").distinct(), "point_id", "left_semi")
    return hits.join(found, "point_id")


def centroids(chunks: DataFrame, owner: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean vector per owner; chunks without a vector do not count. Whole vectors are summed
    before the shuffle, so an owner costs one row per task however many chunks it has."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = chunks.where(F.col(vector).isNotNull()).groupBy(owner).agg(Summarizer.mean(dense).alias("_mean"))
    return means.select(owner, vector_to_array("_mean").alias("embedding"))


def capability_vectors(capabilities: DataFrame, store: DataFrame, key: str = "vec_id") -> DataFrame:
    """Capabilities with their stored vector; those that have none are left out."""
    return capabilities.join(store.select(key, "embedding").where("embedding IS NOT NULL"), key)


def count_points(points: DataFrame, firm_id: str | None = None, document_type: str | None = None) -> DataFrame:
    wanted = {"firm_id": firm_id} if firm_id else None
    return payload_filter(points, wanted, document_type).agg(F.count(F.lit(1)).alias("points"))


def point_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("document_type", "firm_id").agg(F.count(F.lit(1)).alias("points"))


def collection_stats(collections: dict[str, DataFrame]) -> DataFrame:
    """Points and vectors held per named collection."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("points"), F.count("embedding").alias("vectors")).select(
            F.lit(name).alias("collection"), "points", "vectors"
        )
        for name, df in collections.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vector_diagnostics(pairs: DataFrame) -> DataFrame:
    """Per (notice, capability) row with ``notice_vector`` and ``embedding``: norm, size and similarity."""
    similarity = vx.cosine("notice_vector", "embedding")
    return pairs.withColumns(
        {
            "vector_norm": F.round(vx.norm("embedding"), 4),
            "vector_dimensions": F.size("embedding"),
            "similarity_score": F.round(similarity, 4),
        }
    ).withColumn("zero_similarity", F.col("similarity_score") == 0)
