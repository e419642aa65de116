"""Benchmark decontamination with a generalised suffix automaton over the words of test items."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import cut, pieces, texts

#: Every ASCII byte that is no letter or digit parts words; A-Z are lower-cased; other bytes belong to words.
TO_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Item words in one automaton, half a kilobyte each in a worker. More items make more automata, each scanned in a pass of its own.
SHARD_WORDS = 500_000
#: Bytes of a built automaton in one row.
ROW_BYTES = 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class _Ids(dict):
    """Word numbers; -1 for a word that no item has."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Automaton:
    """All runs of words of the test items, with the windows that end in each state.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. The runs of one state are suffixes of each other, so a state and a length name a
    window. ``ends`` has the lengths of a state's windows and, for each, the number of its group of
    items in ``groups``; ``up`` is the nearest state with windows on the way to shorter suffixes.
    """

    window: int
    ids: _Ids = field(default_factory=_Ids)
    edges: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    given: list[tuple[str, list[int]]] = field(default_factory=list)
    ends: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    up: list[int] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    shortest: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def add(self, item_id: str, text: bytes) -> int:
        got = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
        if got:
            self.given.append((item_id, got))
            last = 0
            for w in got:
                last = self._extend(last, w)
        return len(got)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int) -> int:
        """The state for the run that ends ``at -> word`` and is no longer than it, cloned out if need be."""
        to = self.edges[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._new(self.length[at] + 1, dict(self.edges[to]), self.link[to])
        while at >= 0 and self.edges[at].get(word) == to:
            self.edges[at][word] = clone
            at = self.link[at]
        self.link[to] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.edges[last]:
            return self._split(last, word)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.edges[at]:
            self.edges[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def close(self) -> Automaton:
        """Call after the last ``add``: marks each state with the windows that end in it."""
        owners: dict[tuple[int, int], list[str]] = {}
        many, firsts = max(len(self.ids), 1), set()
        for item, got in self.given:
            size, state = min(self.window, len(got)), 0
            for k, w in enumerate(got):
                state = self.edges[state][w]
                while self.length[self.link[state]] >= size:  # the state of the last ``size`` words
                    state = self.link[state]
                if k + 1 >= size:
                    owned = owners.setdefault((state, size), [])
                    if item not in owned[-1:]:
                        owned.append(item)
            firsts.update(a * many + b for a, b in zip(got, got[1:], strict=False))
        numbers: dict[tuple[str, ...], int] = {}
        for (state, size), owned in owners.items():
            self.ends.setdefault(state, []).append((size, numbers.setdefault(tuple(owned), len(numbers))))
        self.groups = [list(g) for g in numbers]
        self.shortest = min((size for _, size in owners), default=0)
        self.pairs = np.array(sorted(firsts), np.int64)
        self.up = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if above in self.ends else self.up[above]
        self.given = []
        return self

    def spans(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """``(first word, words, item ids)`` of the stretches of ``words`` that occurrences of windows cover.

        Windows that overlap or touch make one stretch, which names each item once. Word pairs that
        no item has cut the stream first, as no match runs across them. Only parts as long as the
        shortest window are walked through the automaton, which tracks the longest matching length
        at each word.
        """
        if not self.ends or len(words) < self.shortest:
            return []
        got = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        known = got >= 0
        if not known.any():
            return []
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        if len(at) and len(self.pairs):
            code = got[at] * len(self.ids) + got[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == code
        elif len(at):
            joined[at] = False
        starts = np.flatnonzero(known & ~np.r_[False, joined])
        ends = np.flatnonzero(known & ~np.r_[joined, False]) + 1
        out: list[tuple[int, int, set[int]]] = []
        for a, b in zip(starts, ends, strict=True):
            if b - a >= self.shortest:
                for first, end, group in sorted(self._walk(got[a:b].tolist(), int(a))):
                    if out and first <= out[-1][1]:
                        out[-1][2].add(group)
                        out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
                    else:
                        out.append((first, end, {group}))
        return [(first, end - first, sorted({i for g in met for i in self.groups[g]})) for first, end, met in out]

    def _walk(self, got: list[int], first: int) -> list[tuple[int, int, int]]:
        """``(first word, end, group)`` of each window: those that end in a state reached, no longer than what matches there, and in the states of its suffixes."""
        out, state, matched = [], 0, 0
        for k, w in enumerate(got, first + 1):
            while state and w not in self.edges[state]:
                state = self.link[state]
                matched = self.length[state]
            if w not in self.edges[state]:
                continue
            state, matched = self.edges[state][w], matched + 1
            at = state
            while at >= 0:
                for size, group in self.ends.get(at, ()):
                    if size <= matched:
                        out.append((k - size, k, group))
                at = self.up[at]
        return out


def automata(items: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata over ``items(item_id, text)``, each of about ``shard_words`` words, at least one.

    Items are dealt by hash, and each automaton is built in a task and written to the shared
    folder, so the driver only hands on one of them at a time. Repeated rows count once, null and
    empty texts have no window, and a null id is the empty one.
    """
    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    counted = F.size(F.filter(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda w: w != ""))
    total = given.agg(F.sum(counted)).first()[0] or 0
    n = max(1, -(-total // shard_words))

    def build(group: pa.Table) -> pa.Table:
        made = Automaton(window)
        for item, text in sorted(zip(group.column(1).to_pylist(), texts(group.column(2)), strict=True)):
            made.add(item, text)
        said = pickle.dumps(made.close(), pickle.HIGHEST_PROTOCOL)
        rows = [said[at : at + ROW_BYTES] for at in range(0, len(said), ROW_BYTES)]
        return pa.table({"shard": pa.array([group.column(0)[0].as_py()] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int64()), "said": pa.array(rows, pa.binary())})

    dealt = given.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("shard"), "item", "text")
    built = cut(dealt.groupBy("shard").applyInArrow(build, "shard long, row long, said binary"))
    shards = sorted(r.shard for r in built.select("shard").distinct().collect())
    for shard in shards:
        yield pickle.loads(b"".join(r.said for r in built.where(F.col("shard") == shard).orderBy("row").toLocalIterator()))
    if not shards:
        yield Automaton(window).close()


SPANS = "array<struct<first:long,words:long,items:array<string>>>"


def _scan(docs: DataFrame, shared: Broadcast, column: str) -> DataFrame:
    where = docs.columns.index("text")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("items", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        for batch in batches:
            counts, found = [], []
            for text in texts(batch.column(where)):
                words = words_of(text)
                counts.append(len(words))
                found.append([{"first": a, "words": n, "items": o} for a, n, o in auto.spans(words)])
            names = [*batch.schema.names, "n_words", column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind)], names)

    schema = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn(column, F.lit(None).cast(SPANS)).schema
    return docs.mapInArrow(run, schema)


def with_spans(docs: DataFrame, items: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``n_words`` and ``spans``: the stretches of each whole text that windows of ``items`` cover.

    Stretches of one automaton do not overlap, and each names its items once. A null or empty text has no words and no spans. Repeated rows are kept. ``docs`` must not have
    columns named ``n_words`` or ``spans``.
    """
    done = None
    for auto in automata(items, window, shard_words):
        shared = docs.sparkSession.sparkContext.broadcast(auto)
        if done is None:
            done = _scan(docs, shared, "spans")
        else:
            done = _scan(done.drop("n_words"), shared, "_more").withColumn("spans", F.concat("spans", "_more")).drop("_more")
    return done


def _digest(found: DataFrame, coverage: int) -> DataFrame:
    """Adds ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    where = found.columns.index("spans"), found.columns.index("n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items, shas, bad = [], [], [], []
            for spans, n in zip(batch.column(where[0]).to_pylist(), batch.column(where[1]).to_pylist(), strict=True):
                hit = covered(spans)
                ids = sorted({i for s in spans for i in s["items"]})
                hits.append(hit)
                items.append(len(ids))
                shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                bad.append(hit > 0 and coverage * hit >= n)
            new = [pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(shas, pa.string()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = (
        found.withColumn("n_hit", F.lit(0).cast("long")).withColumn("n_items", F.lit(0).cast("long"))
        .withColumn("items_sha256", F.lit("")).withColumn("contaminated", F.lit(True)).schema
    )
    return found.mapInArrow(run, schema)


def covered(spans: list[dict]) -> int:
    """Words inside any of ``spans``."""
    total, end = 0, 0
    for first, words in sorted((s["first"], s["words"]) for s in spans):
        total += max(0, first + words - max(first, end))
        end = max(end, first + words)
    return total


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: hit words, items met, and whether at least 1/``coverage`` of its words are hit.

    Null texts have no words and are clean. ``items_sha256`` is of the met item ids, sorted as
    strings and joined by commas.
    """
    found = with_spans(docs.select("doc_id", "text"), items, window).drop("text")
    return _digest(found, coverage).drop("spans")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the rows that are contaminated; all columns stay. Null texts are clean.

    Rows pass the workers once for each automaton, and each text only once at a time: the pass of
    the last automaton drops what is contaminated by the spans of all of them.
    """
    names, earlier = docs.columns, "_spans"
    while earlier in names:
        earlier += "_"
    last = None
    for auto in automata(items, window, shard_words):
        if last is not None:
            docs = _spans_too(docs, last, earlier)
        last = docs.sparkSession.sparkContext.broadcast(auto)
    return _clean_rows(docs, last, earlier, coverage).select(*names)


def _spans_too(docs: DataFrame, shared: Broadcast, column: str) -> DataFrame:
    """``docs`` with the places of one more automaton's windows added to ``column``: ``(first, words)`` of each."""
    kind = "array<struct<first:long,words:long>>"
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    if column not in docs.columns:
        docs = docs.withColumn(column, F.array().cast(kind))
    where, held = docs.columns.index("text"), docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        for batch in pieces(batches):
            found = [
                [*before, *({"first": a, "words": n} for a, n, _ in auto.spans(words_of(text)))]
                for text, before in zip(texts(batch.column(where)), batch.column(held).to_pylist(), strict=True)
            ]
            yield batch.set_column(held, column, pa.array(found, arrow))

    return docs.mapInArrow(run, docs.schema)


def _clean_rows(docs: DataFrame, shared: Broadcast, earlier: str, coverage: int) -> DataFrame:
    """The rows of ``docs`` that ``shared`` and the places in ``earlier`` (if there) leave clean."""
    where = docs.columns.index("text")
    held = docs.columns.index(earlier) if earlier in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        for batch in pieces(batches):
            before = [[]] * batch.num_rows if held is None else batch.column(held).to_pylist()
            keep = []
            for text, known in zip(texts(batch.column(where)), before, strict=True):
                words = words_of(text)
                hit = covered([*known, *({"first": a, "words": n} for a, n, _ in auto.spans(words))])
                keep.append(hit == 0 or coverage * hit < len(words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_spans(docs: DataFrame, items: DataFrame, window: int = 13, longest: int = 0, coverage: int = 0) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``.

    Overlapping windows make one span. A span goes if it has more than ``longest`` words; all spans
    of a text go if at least 1/``coverage`` of its words are hit (0: no such limit). The words and
    separators outside the spans stay as they are; each span leaves one space. Other columns stay.
    """
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    names = docs.columns
    packed = with_spans(docs.select(F.struct(*names).alias("_row"), "text"), items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted(spans, key=lambda s: s["first"]):
                    if merged and s["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["first"] + s["words"])
                    else:
                        merged.append([s["first"], s["first"] + s["words"]])
                every = coverage and coverage * covered(spans) >= n
                gone = [m for m in merged if every or m[1] - m[0] > longest]
                if gone:
                    at = [m.span() for m in word.finditer(bytes(text).lower())]
                    kept, end = [], 0
                    for a, b in gone:
                        kept.append(text[end : at[a][0]])
                        end = at[b - 1][1]
                    text = b" ".join([*kept, text[end:]])
                out.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])

    schema = packed.select("_row", F.col("text").alias("_text")).schema
    done = packed.mapInArrow(run, schema)
    return done.select(*[
        F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias("text") if n == "text" else F.col("_row")[n].alias(n) for n in names
    ])
