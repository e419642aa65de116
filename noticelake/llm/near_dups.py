"""SimHash near-duplicate groups by the generalised pigeonhole principle.

A document's fingerprint is voted by its word shingles. Two fingerprints within ``radius``
differing bits must, for bit partitions with thresholds that sum to ``radius - m + 1``, be within
the threshold on at least one partition. Correlated bits are put into one partition, thresholds
are allocated by dynamic programming on estimated candidate counts, and candidates are verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import cut, texts
from noticelake.llm.components import components

BITS = 64
#: Shingles hashed at once; bounds the memory of a very long text.
STEP = 65_536
#: A bucket beyond so many fingerprints is split into blocks that meet in pairs, each pair in a task group of its own.
BLOCK = 8_192
#: What emitting and sorting a bucket row costs, in compared pairs.
ROW_COST = 40


def fingerprint(text: bytes, words_each: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes (XXH64, seed 42); 0 for no words.

    A-Z are lower-cased, words are parted by ASCII white space, fewer words than a shingle has are
    one shingle, and repeated shingles vote again.
    """
    import xxhash

    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        return hashed(b" ".join(words))
    ones, n = np.zeros(BITS, np.int64), len(words) - words_each + 1
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + words_each - 1]
        shingles = map(b" ".join, zip(*(part[k : len(part) - words_each + 1 + k] for k in range(words_each)), strict=True))
        hashes = np.fromiter(map(hashed, shingles), np.uint64, len(part) - words_each + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words_each: int = 4, column: str = "fp") -> DataFrame:
    """``docs`` with a long ``column`` holding the fingerprint of ``text`` (null: empty, fingerprint 0)."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words_each) for t in texts(batch.column(where))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], [*batch.schema.names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0).cast("long")).schema)


# --- partitions and thresholds -------------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together over all rows of ``fps(fp)``; the driver gets 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), STEP):
                bits = np.unpackbits(raw[at : at + STEP], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), pa.array(list(total))], ["bit", "together"])

    rows = (
        fps.select("fp").mapInArrow(run, "bit long, together array<long>")
        .groupBy("bit").agg(F.array(*[F.sum(F.col("together")[k]) for k in range(BITS)]).alias("together")).collect()
    )
    out = np.zeros((BITS, BITS))
    for row in rows:
        out[row.bit] = row.together
    return out


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown from a seed by its most correlated bits."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs(together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        rest = sorted(left)
        group = [max(rest, key=lambda b: related[b, rest].sum())]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: related[b, group].sum()))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one per partition, that sum to ``total``; ``costs[i][t]`` is that of ``t`` at ``i``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (spent, chosen) in best.items():
            for t, c in cost.items():
                if have + t not in step or step[have + t][0] > spent + c:
                    step[have + t] = (spent + c, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _within(shares: list[float], t: int) -> float:
    """Chance that two rows differ in at most ``t`` of some independent bits, given each bit's chance to agree."""
    chance = [1.0] + [0.0] * t
    for agree in shares:
        for k in range(t, -1, -1):
            chance[k] = chance[k] * agree + (chance[k - 1] * (1 - agree) if k else 0)
    return sum(chance)


def choose_masks(fps: DataFrame, n: int, radius: int) -> list[int]:
    """Bit masks such that any two fingerprints within ``radius`` agree under at least one of them.

    A partition with threshold t gives a mask for each way to leave out t of its bits. Pairs that
    agree on a whole partition are counted over all rows; pairs within t more bits are estimated
    from that count and the bits' own agreement.
    """
    together = bit_statistics(fps)
    mean = np.diag(together) / max(n, 1)
    agree = mean**2 + (1 - mean) ** 2
    options = {m: group_bits(together, n, m) for m in range(max(2, radius // 2 + 1), radius + 3)}
    wide = {(m, i): sum(1 << b for b in g) for m, groups in options.items() for i, g in enumerate(groups)}
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v"))
        for (m, i), mask in wide.items()
    ])).alias("c")
    counted = fps.select(cells).groupBy("c.m", "c.i", "c.v").count()
    c = F.col("count").cast("double")
    same = {(r.m, r.i): r.pairs for r in counted.groupBy("m", "i").agg(F.sum(c * (c - 1) / 2).alias("pairs")).collect()}
    cheapest, chosen = math.inf, []
    for m, groups in options.items():
        costs = []
        for i, group in enumerate(groups):
            shares = [float(agree[b]) for b in group]
            none = max(_within(shares, 0), 1e-300)
            costs.append({-1: 0.0} | {
                t: math.comb(len(group), t) * (same.get((m, i), 0.0) + ROW_COST * n) + same.get((m, i), 0.0) * (_within(shares, t) / none - 1)
                for t in range(3)
            })
        cost, thresholds = allocate(costs, radius - m + 1)
        if cost < cheapest:
            cheapest, chosen = cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return [sum(1 << b for b in group if b not in out) for group, t in chosen for out in itertools.combinations(group, t)]


# --- probing and verification --------------------------------------------------------------------------------------


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each node of ``pairs`` with its component's smallest node, without the smallest nodes themselves."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(fp: np.ndarray, run: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``radius`` that join all linked fingerprints of each run (rows of equal ``run`` are adjacent)."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    size_of = np.repeat(sizes, sizes)
    out, short = [], np.flatnonzero(size_of <= 64)
    lag = 1
    while len(short := short[short + lag < len(run)]) and len(short := short[run[short + lag] == run[short]]):
        near = short[np.bitwise_count(fp[short] ^ fp[short + lag]) <= radius]
        if len(near):
            out.append((fp[near], fp[near + lag]))
        lag += 1
    for at, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        # Breadth first: what is reached leaves the rest, so a dense run costs about its length.
        rest = fp[at : at + size]
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    out.append((np.full(int(near.sum()), x), rest[near]))
                    queue.extend(rest[near])
                    rest = rest[~near]
    return out


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                change = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
                if pairs := _links(rows[:, 4].view(np.uint64), np.r_[0, np.cumsum(change)], radius):
                    a, b = _forest(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns], axis=1)
            kept = rows if kept is None else np.concatenate([kept, rows])
            new = np.flatnonzero((kept[1:, :4] != kept[:-1, :4]).any(axis=1))
            if len(new):
                done, kept = kept[: new[-1] + 1], kept[new[-1] + 1 :]
                yield from linked(np.ascontiguousarray(done))
        if kept is not None:
            yield from linked(np.ascontiguousarray(kept))

    return run


def linked_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``(node, root)`` for the distinct fingerprints ``fps(fp)`` that have others within ``radius`` bits.

    Chains of links count. Buckets of any size are handled whole: beyond ``BLOCK`` rows they are
    split into hashed blocks and every pair of blocks is compared.
    """
    n = fps.count()
    masks = choose_masks(fps, n, radius)
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("code"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for k, mask in enumerate(masks)
    ])).alias("k")).select("k.code", "k.value", "fp")
    large = rows.groupBy("code", "value").count().where(F.col("count") > BLOCK).select(
        "code", "value", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
    paired = (
        rows.join(large, ["code", "value"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        .select("code", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    key = ["code", "value", "i", "j"]
    edges = paired.repartition(*key).sortWithinPartitions(*key).mapInArrow(_link_batches(radius), "a long, b long")
    return components(edges)


def near_duplicates(docs: DataFrame, radius: int = 4, words_each: int = 4, key: str = "doc_id") -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``; ``component_id`` is the smallest key reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay. A null
    key keeps its row and is never a component's id unless the component has no other key.
    """
    marked = cut(with_fingerprints(docs.select(key, "text"), words_each).select(key, "fp"))
    least = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = linked_fingerprints(least.select("fp"), radius)
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words_each: int = 4, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest key, ties by text hash.

    Keeps all columns of ``docs``. Rows with a null key stay only if their group has no other.
    """
    print_of = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = cut(
        with_fingerprints(docs.select(key, "text"), words_each)
        .select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), print_of.alias("print")).alias("who"), "fp")
    )
    least = cut(marked.groupBy("fp").agg(F.min("who").alias("who")))
    roots = linked_fingerprints(least.select("fp"), radius)
    return first_of_each(docs, least, roots, "fp", key)


def first_of_each(docs: DataFrame, least: DataFrame, roots: DataFrame, node: str, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are the least ``who(none, id, print)`` of ``least`` in each group of ``roots(node, root)``."""
    print_of = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = (
        least.join(roots.withColumnRenamed("node", node), node, "left")
        .groupBy(F.coalesce("root", node).alias("root")).agg(F.min("who").alias("who"))
        .select(F.col("who.none").alias("_none"), F.coalesce("who.id", F.lit(0)).alias("_id"), F.col("who.print").alias("_print"))
    )
    # One shuffle of the rows serves both the join and the choice among repeated rows.
    by = ["_none", "_id", "_print"]
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).isNull().alias("_none"), F.coalesce(key, F.lit(0)).alias("_id"), print_of.alias("_print"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("_print"))
    return named.join(kept, by, "left_semi").withColumn("_first", first).where("_first = 1").select("_row.*")
