"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, whole sets verify them.

A pair of similarity s agrees on all ``ROWS`` minima of at least one of ``BANDS`` bands with the chance
1 - (1 - s**ROWS)**BANDS; at 0.8 three pairs in a million are not met. Every pair of a bucket is
verified on the two whole sets, so no link is made of an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import cut, pieces, texts
from noticelake.llm.components import components
from noticelake.llm.near_dups import STEP, _forest, first_of_each

BANDS, ROWS = 24, 4
#: A bucket whose sets hold more shingles is split into blocks that meet in pairs, each pair in a task group of its own.
BLOCK_SHINGLES = 2_000_000
#: Shingles whose minima are taken at once.
MINIMA_STEP = 4_096

_random = np.random.default_rng(42)
TURNS = _random.integers(0, 2**63, BANDS * ROWS, np.uint64)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes (XXH64) of the word shingles of a text; words as in ``near_dups.fingerprint``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    if len(words) <= words_each:
        return np.array([hashed(b" ".join(words))], np.uint64)
    found, n = [], len(words) - words_each + 1
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + words_each - 1]
        size = len(part) - words_each + 1
        joined = map(b" ".join, zip(*(part[k : size + k] for k in range(words_each)), strict=True))
        found.append(np.unique(np.fromiter(map(hashed, joined), np.uint64, size)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def minima(found: np.ndarray) -> np.ndarray:
    """The least of the set's values under each of ``BANDS * ROWS`` fixed reorderings of the 64-bit numbers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), MINIMA_STEP):
        turned = (found[None, at : at + MINIMA_STEP] ^ TURNS[:, None]) * FACTORS[:, None]
        np.minimum(least, turned.min(axis=1), out=least)
    return least


def band_values(least: np.ndarray) -> np.ndarray:
    """A value for each band of each row of ``least``."""
    rows = least.reshape(len(least), BANDS, ROWS)
    value = np.zeros(rows.shape[:2], np.uint64)
    for k in range(ROWS):
        value = (value ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def with_bands(docs: DataFrame, words_each: int) -> DataFrame:
    """``docs`` without ``text``, with the hash ``node`` of the set of shingles, its ``size`` and its ``bands``."""
    import xxhash

    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, sizes, least = [], [], np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
            for k, text in enumerate(texts(batch.column(where))):
                found = shingles(text, words_each)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), seed=42) if len(found) else 0)
                sizes.append(len(found))
                least[k] = minima(found)
            flat = pa.array(band_values(least).reshape(-1).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat)
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, _ in kept), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), bands],
                [*(n for _, n in kept), "node", "size", "bands"],
            )

    zero = F.lit(0).cast("long")
    return docs.mapInArrow(run, docs.drop("text").select("*", zero.alias("node"), zero.alias("size"), F.array(zero).alias("bands")).schema)


def with_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """``docs(node, text)`` as ``(node, found)``, the set's hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            found = [shingles(t, words_each).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "found"])

    return docs.select("node", "text").mapInArrow(run, "node long, found binary")


def _set_links(nodes: np.ndarray, found: list[np.ndarray], at_least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that join all those linked by sets of similarity ``at_least``."""
    sizes = np.array([len(f) for f in found])
    ends = np.cumsum(sizes)
    ranks = np.unique(np.concatenate(found), return_inverse=True)[1]
    own = np.zeros(ranks.max() + 1, bool)
    # Breadth first: what is reached leaves the rest, so a dense bucket costs about its length.
    out, rest = [], np.arange(len(nodes))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            fits = (sizes[rest] >= at_least * sizes[x] - 1e-9) & (sizes[x] >= at_least * sizes[rest] - 1e-9)
            if not fits.any():
                continue
            asked = rest[fits]
            mine = ranks[ends[x] - sizes[x] : ends[x]]
            own[mine] = True
            starts = np.cumsum(sizes[asked]) - sizes[asked]
            places = np.arange(sizes[asked].sum()) + np.repeat(ends[asked] - sizes[asked] - starts, sizes[asked])
            shared = np.add.reduceat(own[ranks[places]], starts, dtype=np.int64)
            own[mine] = False
            near = asked[shared >= at_least * (sizes[asked] + sizes[x] - shared) - 1e-9]
            if len(near):
                out.append((np.full(len(near), nodes[x]), nodes[near]))
                queue.extend(near)
                rest = rest[~np.isin(rest, near)]
    return out


def _link_batches(at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(nodes: list[np.ndarray], found: list[bytes]) -> Iterator[pa.RecordBatch]:
            pairs = _set_links(np.concatenate(nodes), [np.frombuffer(f, np.uint64) for f in found], at_least) if len(found) > 1 else []
            if pairs:
                a, b = _forest(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        key, nodes, found = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else []
            for at, to in zip(starts, starts[1:], strict=False):
                if key != tuple(keys[at]):
                    yield from linked(nodes, found)
                    key, nodes, found = tuple(keys[at]), [], []
                nodes.append(batch.column(4).to_numpy(zero_copy_only=False)[at:to].copy())
                found.extend(batch.column(5).slice(at, to - at).to_pylist())
        yield from linked(nodes, found)

    return run


def buckets_of(least: DataFrame) -> DataFrame:
    """``(code, value, node, blocks)``: the members of each bucket of two or more of ``least(node, size, bands)``.

    Of buckets with the same members, as near copies have in many bands, one is kept.
    """
    rows = least.where("size > 0").select("node", "size", F.posexplode("bands").alias("code", "value"))
    buckets = (
        rows.groupBy("code", "value")
        .agg(
            F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("node").alias("lo"), F.max("node").alias("hi"),
            F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("long").alias("blocks"),
        )
        .where("n > 1").groupBy("n", "x", "y", "lo", "hi").agg(F.min(F.struct("code", "value", "blocks")).alias("b")).select("b.*")
    )
    return rows.join(buckets, ["code", "value"]).select(F.col("code").cast("long").alias("code"), "value", "node", "blocks")


def without_similar(docs: DataFrame, at_least: float = 0.8, words_each: int = 5, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard similarity ``at_least``: that of its smallest key.

    Chains of links count, ties go by text hash, all columns stay. Texts without words are one group.
    Rows with a null key stay only if their group has no other.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = cut(
        with_bands(docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), text_hash.alias("print")).alias("who"), "text"), words_each)
    )
    least = cut(marked.groupBy("node").agg(F.min("who").alias("who"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    members = cut(buckets_of(least))
    asked = least.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("who.none").alias("_none"), F.coalesce("who.id", F.lit(0)).alias("_id"), F.col("who.print").alias("_print")
    )
    named = docs.select(F.col(key).isNull().alias("_none"), F.coalesce(key, F.lit(0)).alias("_id"), text_hash.alias("_print"), "text")
    sets = with_sets(named.join(asked, ["_none", "_id", "_print"]), words_each)
    paired = (
        members.join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("code", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "found")
    )
    by = ["code", "value", "i", "j"]
    edges = paired.repartition(*by).sortWithinPartitions(*by).mapInArrow(_link_batches(at_least), "a long, b long")
    return first_of_each(docs, least, components(edges), "node", key)
