"""Best-fit packing of token sequences into fixed-size training sequences, with swap-based local search.

Only lengths matter to a packing, so it is planned on how many pieces there are of each length: at
most ``capacity`` numbers, however many documents there are. Bins of equal content are one pattern
with a count. The pieces then find their places by rank within their length.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import cut
from noticelake.llm.tokenizing import words_for

#: Pieces of one length that are ranked together; longer lists are ranked in salted parts.
RANKED = 2_000

Pattern = tuple[tuple[int, int], ...]


def _fill(pattern: Pattern) -> int:
    return sum(length * k for length, k in pattern)


def _changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    held = Counter(dict(pattern))
    held.subtract(out)
    held.update(into)
    return tuple(sorted(((length, k) for length, k in held.items() if k), reverse=True))


def best_fit(lengths: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over length counts: each length goes to the bins with the least room that suffices."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        for room in sorted(r for r in rooms if r >= length):
            each, groups = room // length, rooms.pop(room)
            while groups and left:
                pattern, bins = groups.pop()
                full = min(bins, left // each)
                rest = left - full * each if full < bins else 0
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        rooms.setdefault(room - k * length, []).append(((*pattern, (length, k)), n))
                        left -= n * k
                spare = bins - full - (1 if rest else 0)
                if spare:
                    rooms.setdefault(room, []).append((pattern, spare))
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if not left:
                break
        each = capacity // length
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                rooms.setdefault(capacity - k * length, []).append((((length, k),), n))
    out: Counter[Pattern] = Counter()
    for groups in rooms.values():
        for pattern, bins in groups:
            out[pattern] += bins
    return out


class Underfull:
    """Patterns with room, and for each what it can hand over at once: nothing, one piece, or two.

    The hand-overs of all patterns lie in flat arrays, so one pattern is held against all others at a time.
    """

    def __init__(self, capacity: int):
        self.capacity, self.number = capacity, {}
        self.patterns: list[Pattern] = []
        self.fill, self.alive = np.zeros(16, np.int64), np.zeros(16, bool)
        self.used, self.entries = 0, np.zeros((4, 64), np.int64)  # sum, pieces, pattern, place among the pattern's own

    def add(self, pattern: Pattern) -> None:
        at = self.number.get(pattern)
        if at is None:
            at = self.number[pattern] = len(self.patterns)
            self.patterns.append(pattern)
            if at == len(self.fill):
                self.fill, self.alive = np.resize(self.fill, 2 * at), np.resize(self.alive, 2 * at)
            self.fill[at] = _fill(pattern)
            own = hand_overs(pattern)
            while self.used + len(own) > self.entries.shape[1]:
                self.entries = np.concatenate([self.entries, np.zeros_like(self.entries)], axis=1)
            here = slice(self.used, self.used + len(own))
            self.entries[:, here] = [[sum(x) for x in own], [len(x) for x in own], [at] * len(own), range(len(own))]
            self.used += len(own)
        self.alive[at] = True

    def drop(self, pattern: Pattern) -> None:
        self.alive[self.number[pattern]] = False

    def best(self, pattern: Pattern, twice: bool):
        """The exchange of ``pattern`` with another that raises the sum of squared fills most: ``(giver, taker,
        given, returned)``, or None. Of two pieces at most one comes back, and of one at most two.
        ``twice`` if the pattern may meet another bin like itself.

        With d the net sum moved, b the giver's fill and a the taker's, the sum rises by 2d(d + a - b).
        """
        me, mine = self.number[pattern], hand_overs(pattern)
        sums, pieces, of, place = self.entries[:, : self.used]
        may = self.alive[of] & (twice | (of != me))
        fills, my_fill = self.fill[of], int(self.fill[me])
        top, found = 0, None
        for k, own in enumerate(mine):
            total = sum(own)
            fits = may & (pieces + len(own) <= 3)
            for giving in (True, False):
                if giving and not own:
                    continue
                d = total - sums if giving else sums - total
                above = d + (fills - my_fill if giving else my_fill - fills)
                room = self.capacity - (fills if giving else my_fill)
                rise = np.where(fits & (d > 0) & (above > 0) & (d <= room), d * above, 0)
                at = int(rise.argmax()) if len(rise) else 0
                if len(rise) and rise[at] > top:
                    other = self.patterns[of[at]]
                    theirs = hand_overs(other)[place[at]]
                    top, found = int(rise[at]), (pattern, other, own, theirs) if giving else (other, pattern, theirs, own)
        return found


def hand_overs(pattern: Pattern) -> list[tuple[int, ...]]:
    """Nothing, each length, and each pair of lengths that a bin of this pattern holds."""
    two = [(a, b) for (a, k), (b, _) in itertools.combinations_with_replacement(pattern, 2) if a != b or k > 1]
    return [(), *((x,) for x, _ in pattern), *two]


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchanges pieces between underfull bins while that raises the sum of squared fills, so that the poorest empty.

    Moves one document or two, or exchanges one for one, two for one or one for two; bins of equal
    content exchange together. Ends when no exchange of any two bins raises the sum, or when the count of
    bins is the least possible. The poorest bins are looked at first; one that no other can better is looked at
    again only by bins that are new since. Time grows with the kinds of underfull bins that best fit
    leaves: none to speak of where documents are short beside the capacity.
    """
    bins = Counter(bins)
    least, n_bins = -(-sum(_fill(p) * n for p, n in bins.items()) // capacity), sum(bins.values())
    under = Underfull(capacity)
    queue: list[tuple[int, Pattern]] = []
    queued: set[Pattern] = set()

    def push(pattern: Pattern) -> None:
        under.add(pattern)
        if pattern not in queued:
            queued.add(pattern)
            heapq.heappush(queue, (_fill(pattern), pattern))

    for pattern in bins:
        if _fill(pattern) < capacity:
            push(pattern)
    while queue and n_bins > least:
        _, pattern = heapq.heappop(queue)
        queued.discard(pattern)
        if not bins[pattern]:
            continue
        step = under.best(pattern, bins[pattern] > 1)
        if step is None:
            continue
        giver, taker, given, returned = step
        n = bins[giver] // 2 if giver == taker else min(bins[giver], bins[taker])
        after = _changed(giver, given, returned), _changed(taker, returned, given)
        for old in (giver, taker):
            bins[old] -= n
        for new in after:
            if new:
                bins[new] += n
                if _fill(new) < capacity:
                    push(new)
            else:
                n_bins -= n
        for old in (giver, taker):
            if not bins[old]:
                del bins[old]
                under.drop(old)
        if bins[pattern]:
            push(pattern)
    return +bins


def layout(bins: Counter[Pattern]) -> dict[str, list[int]]:
    """For each pattern and length: which ranks of that length go where. Sequence numbers start at 0."""
    rows: dict[str, list[int]] = {k: [] for k in ("length", "rank", "each", "sequence", "offset")}
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, n in sorted(bins.items()):
        offset = 0
        for length, each in pattern:
            for name, value in (("length", length), ("rank", used[length]), ("each", each), ("sequence", sequence), ("offset", offset)):
                rows[name].append(value)
            used[length] += n * each
            offset += each * length
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in sequences of at most ``capacity``.

    Every row has a ``length`` of 1 to ``capacity``; rows of length 0 or null are not packed and do
    not come back. ``order`` ranks the pieces of one length. An empty input gives no rows. The
    driver holds at most ``capacity`` counts and the plan made from them.
    """
    pieces = pieces.where("length > 0")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    if counts and max(counts) > capacity:
        raise ValueError("cut pieces to the capacity first")
    plan = layout(local_search(best_fit(counts, capacity), capacity)) if counts else layout(Counter())
    parts = F.array(*[F.lit(-(-counts.get(n, 0) // RANKED) or 1) for n in range(capacity + 1)])
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), parts[F.col("length").cast("int")]))
    before = (
        salted.groupBy("length", "_part").count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count"))
        .drop("count")
    )
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order))
    ranked = salted.withColumn("_rank", place).join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    by = np.lexsort((plan["rank"], plan["length"]))
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64)[by] for k, v in plan.items()})
    where = ranked.columns.index("length"), len(ranked.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows["length"] << 40) + rows["rank"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in where)
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            nth, each = rank - rows["rank"][at], rows["each"][at]
            new = [rows["sequence"][at] + nth // each, rows["offset"][at] + nth % each * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, new)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(run, schema)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: each whole text's ids and the end id, cut every ``capacity`` ids.

    A null or empty text is its end id alone. Repeated rows give pieces of their own. With
    ``keep_ids`` the ids come too, as an array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, wide = words_for(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = words.encode(text or "") + end
                for n, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    out.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), *((np.frombuffer(part, np.uint32).astype(np.int32),) if keep_ids else ())))
            which, *rest = zip(*out, strict=True) if out else ([], [], [], [], [], *([],) * keep_ids)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(list(x), kind) for x, kind in zip(rest, kinds, strict=False))], names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """``pieces_of`` all ``docs``, packed."""
    pieces = cut(pieces_of(docs, tokenizer, capacity, end_id, keep_ids))
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
