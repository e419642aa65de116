"""Spelling variants: words one edit apart, found by comparing blocks of padded code-point matrices.

Two different words are one insertion, deletion or replacement apart exactly if their common prefix
and common suffix together reach the longer length less one. One of the two then covers at least
half of that, so only words that share such a half are compared: they make a group, a group is cut
into blocks, and pairs of blocks make tiles. A tile is compared densely, as two matrices of code
points, one aligned at the words' starts and one at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticelake.llm.common import cut

RUN = "([A-Za-z\\u00C0-\\u00FF]{%d,})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, CELLS = 256, 1 << 22
PAIRS = "word string, near string, near_n long"


def noisy_words(docs: DataFrame, every: int = 31, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """``(word, n)``: letter runs with a letter dropped from one in ``every``, counted over all documents.

    A run is a maximal ``[A-Za-z\\u00C0-\\u00FF]+`` of the whole text, A-Z in lower case. With h the
    crc32 of ``<doc_id>:<run>``, a run with h divisible by ``every`` loses its code point
    ``h % length``. Words of fewer than ``least_length`` code points or ``least_n`` occurrences are
    left out; shorter runs cannot give longer words. Null texts have no runs, a null id reads as empty.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN % least_length), F.lit(1))).alias("run")
    ).select("d", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def group_variants(words: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words(word, n)``, one row a word.

    ``n_near`` counts the words one edit away. ``form`` is the one of them with the largest ``n``
    (ties: smallest in code-point order) if that is at least ``ratio`` times the word's own, else
    null; ``root`` is the last word on the way of forms, or the word. Null and empty words are left
    out, rows of one word add up, an empty table gives no rows, other columns are ignored.
    """
    words = cut(words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    none = F.lit(None)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), F.col("near"))))
    met = words.select("word", "n", none.cast("string").alias("near"), none.cast("long").alias("near_n")).unionByName(
        near_pairs(words, block).withColumn("n", none.cast("long"))
    ).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    formed = F.coalesce(-F.col("best.k") >= F.lit(ratio) * F.col("n"), F.lit(False))
    rows = cut(met.select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", "n_near", F.when(formed, -F.col("best.k")).alias("form_n")
    ))
    return rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` by doubling the ways of ``links(word, form)``; counts grow along a way, so none is a circle and none is long."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        # Doubled links of all words: a root that is a word has a way of its own.
        step = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        now = cut(now.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, near, near_n)`` for all ordered pairs of different words one edit apart, each once.

    ``words(word, n)`` must hold each word once. A group of equal half, side and longer length whose
    words fill several blocks meets itself block by block, so no task holds more than two blocks of it.
    """
    length = F.length("word")
    sides = F.explode(F.array(*[
        F.struct((length + more).alias("longer"), F.lit(side).alias("side"), half(more, side).alias("key")) for more in (0, 1) for side in (0, 1)
    ]))
    keyed = words.select("word", "n", sides.alias("g")).select("word", "n", "g.*")
    group = ["longer", "side", "key"]
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    # Fewer words make a block where they are long.
    rows = F.greatest(F.lit(1), F.least(F.lit(block), (F.lit(CELLS) / F.col("longer")).cast("int")))
    split = keyed.join(sizes, group).withColumn("blocks", F.ceil(F.col("size") / rows).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(11), F.col("word")), F.col("blocks")).cast("int")
    tiles = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n"
    )
    order = [*group, "i", "j"]
    return tiles.repartition(*order).sortWithinPartitions("longer", "side", "key", "i", "j", "own", "word").mapInArrow(_compare, PAIRS)


def half(more: int, side: int) -> Column:
    """A hash of the first (side 0) or last half of a word; a longer length of ``length + more`` sets the half."""
    size = F.ceil((F.length("word") + (more - 1)) / 2).cast("int")
    return F.xxhash64(F.substring("word", F.lit(1), size) if side == 0 else F.substring(F.col("word"), F.length("word") - size + 1, size))


def _compare(batches: Iterator[pa.RecordBatch]):
    """Near pairs of each tile. Rows come sorted by tile; neighbouring small tiles of one length and side share a comparison."""
    held: list[tuple] = []
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("longer", "side", "key", "i", "j", "own", "n")) + (np.array(batch.column("word").to_pylist(), object),))
        columns = [np.concatenate(c) for c in zip(*held)]
        starts = _starts(columns[:5])
        # The last tile may go on in the next batch.
        end = starts[-1] if len(starts) else 0
        yield from _tiles([c[:end] for c in columns], starts[:-1], end)
        held = [tuple(c[end:] for c in columns)]
    if held:
        columns = [np.concatenate(c) for c in zip(*held)]
        yield from _tiles(columns, _starts(columns[:5]), len(columns[0]))


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    if not len(keys[0]):
        return np.zeros(0, int)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, new])


def _tiles(columns, starts, end):
    longer, side = columns[0], columns[1]
    ends = np.r_[starts[1:], end]
    first = 0
    while first < len(starts):
        last = first
        a = starts[first]
        while last + 1 < len(starts) and ends[last + 1] - a <= 64 and longer[starts[last + 1]] == longer[a] and side[starts[last + 1]] == side[a]:
            last += 1
        b = ends[last]
        tile = np.repeat(np.arange(last - first + 1), ends[first:last + 1] - starts[first:last + 1])
        yield from _tile(int(longer[a]), int(side[a]), tile, columns[3][a:b], columns[4][a:b], columns[5][a:b], columns[6][a:b], columns[7][a:b])
        first = last + 1


def padded(words, width: int, at_end: bool) -> np.ndarray:
    """Code points of each word, one row a word, filled up with zeros behind the word or before it."""
    text = "".join(w.rjust(width, "\0") if at_end else w.ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of ``a`` with each row of ``b``."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(2)
    return np.where(differ.any(2), first, a.shape[1])


def _tile(longer: int, side: int, tile, i, j, own, n, words):
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    heads, tails = padded(words, longer, False), padded(words, longer, True)[:, ::-1]
    half, found_a, found_b = longer // 2, [], []
    slab = max(1, CELLS // max(1, longer * len(words)))
    for at in range(0, len(words), slab):
        rows = slice(at, at + slab)
        # Words of the same block meet in the block's own tile only.
        may = (tile[rows, None] == tile) & (np.arange(len(words))[rows, None] < np.arange(len(words))) & ((i == j)[rows, None] | (own[rows, None] != own))
        may &= np.maximum(lengths[rows, None], lengths) == longer
        if not may.any():
            continue
        prefix, suffix = common(heads[rows], heads), common(tails[rows], tails)
        near = may & (prefix + suffix >= longer - 1)
        # A pair whose both halves agree belongs to the group of its beginning.
        near &= (prefix >= half) if side == 0 else (suffix >= half) & (prefix < half)
        a, b = np.nonzero(near)
        found_a.append(a + at)
        found_b.append(b)
    if found_a and sum(map(len, found_a)):
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        a, b = np.r_[a, b], np.r_[b, a]
        yield pa.RecordBatch.from_arrays([pa.array(words[a], pa.string()), pa.array(words[b], pa.string()), pa.array(n[b])], ["word", "near", "near_n"])
