"""Toxic documents by a lexicon whose misspellings a Levenshtein automaton finds, weighed by context.

The lexicon is learned: words and word beginnings that labelled toxic documents hold far more often
than clean ones. Each worker intersects its trie with a Levenshtein automaton. A hit counts apart
where it is quoted rather than meant: inside a pair of quotation marks that both stand near it, or
that a word of reporting stands next to.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticelake.llm.common import cut, pieces

#: A term stands in so many toxic labelled texts at least, and in one of ``RARE`` of them.
LEAST, RARE = 5, 100
#: Labelled rows, the first by hash of their id, that the final weights are fitted on.
FIT_ROWS = 20_000
#: Letters of a word beginning that may be an entry of its own.
STEMS = (4, 9)
#: Whole words of at least so many letters are also found misspelt; of shorter ones, of ``BRIEF_LETTERS``, only misspellings whose own counts show it.
FUZZY_LETTERS, BRIEF_LETTERS = 5, 4
#: Log-odds from which a term is typical of toxic texts, and under which a misspelling, a standard error added, is a word of its own.
TYPICAL, OWN_WORD = 3.0, 1.0
#: Words on each side that may mark a hit as quoted.
CONTEXT = 4

#: Words and automaton states that a worker remembers.
REMEMBERED, STATES = 100_000, 20_000
#: Labels sent to every task up to so many rows (about 16 bytes each); more are joined by a shuffle.
SENT_LABELS = 2_000_000
NO_MATCH = (0.0, 0.0)
NO_HITS = (0.0,) * 5

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
WORDS_SQL = r"[^\p{L}\p{N}]+"
# Words of reporting; quotation marks that open, with those that close them. A straight mark does both.
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls reported cited dijo escribió llamó dit écrit appelé sagte schrieb nannte".split())
CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "‟": "”", "«": "»", "»": "«", "〝": "〞"}
MARK = re.compile("[\"“”„«»‟〝〞]|\n\\s*\n")


@dataclass
class Lexicon:
    """A trie of terms and the lazily built automaton of all words within one edit of a whole-word term.

    A state is the set of (trie node, edits so far); states and steps are remembered, so a known
    beginning costs one lookup a letter.
    """

    terms: dict[str, float]  # a stem ends with "*"
    clean: frozenset[str] = frozenset()
    brief: frozenset[str] | None = frozenset()  # misspellings of terms of BRIEF_LETTERS; None allows all
    edits: int = 1
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    exact: dict[int, float] = field(default_factory=dict)
    stem: dict[int, float] = field(default_factory=dict)
    fuzzy: dict[int, float] = field(default_factory=dict)
    short: dict[int, float] = field(default_factory=dict)
    open_to: list[bool] = field(default_factory=lambda: [False])
    numbers: dict[frozenset[tuple[int, int]], int] = field(default_factory=dict)
    states: list[frozenset[tuple[int, int]]] = field(default_factory=list)
    steps: list[dict[str, int]] = field(default_factory=list)
    known: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, weight in sorted(self.terms.items()):
            word, at, path = term.removesuffix("*"), 0, [0]
            for c in word:
                if c not in self.nodes[at]:
                    self.nodes.append({})
                    self.open_to.append(False)
                    self.nodes[at][c] = len(self.nodes) - 1
                at = self.nodes[at][c]
                path.append(at)
            (self.stem if term.endswith("*") else self.exact)[at] = weight
            least = BRIEF_LETTERS if self.brief or self.brief is None else FUZZY_LETTERS
            if not term.endswith("*") and len(term) >= least:
                (self.fuzzy if len(term) >= FUZZY_LETTERS else self.short)[at] = weight
                for k in path:
                    self.open_to[k] = True

    def __reduce__(self):
        return _shared, (tuple(sorted(self.terms.items())), self.clean, self.brief)

    def _spread(self, states: dict[int, int]) -> frozenset[tuple[int, int]]:
        """Adds what a left-out letter reaches, and keeps the fewest edits at each node."""
        todo = list(states)
        while todo:
            at = todo.pop()
            cost = states[at] + 1
            if cost <= self.edits:
                for to in self.nodes[at].values():
                    if self.open_to[to] and states.get(to, 99) > cost:
                        states[to] = cost
                        todo.append(to)
        return frozenset(states.items())

    def _step(self, state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        found: dict[int, int] = {}
        for at, cost in state:
            for letter, to in self.nodes[at].items():
                new = cost if letter == c else cost + 1
                if (new == 0 or (new <= self.edits and self.open_to[to])) and found.get(to, 99) > new:
                    found[to] = new
            if cost < self.edits and self.open_to[at] and found.get(at, 99) > cost + 1:
                found[at] = cost + 1
        return self._spread(found)

    def match(self, word: str) -> tuple[float, float]:
        """The weights of the best exact (word or stem) and the best misspelt entry; 0 for none."""
        got = self.known.get(word)
        if got is None:
            got = self._match(word)
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def _number(self, state: frozenset[tuple[int, int]]) -> int:
        n = self.numbers.get(state)
        if n is None:
            if len(self.states) >= STATES:  # start anew; the automaton is rebuilt as words need it
                self.numbers.clear()
                self.states.clear()
                self.steps.clear()
                self._number(self._spread({0: 0}))
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return n

    def _match(self, word: str) -> tuple[float, float]:
        if not self.states:
            self._number(self._spread({0: 0}))
        state, best, at = 0, 0.0, 0
        for c in word:
            if at >= 0:
                at = self.nodes[at].get(c, -1)
                if at in self.stem:
                    best = max(best, self.stem[at])
            if state >= 0:
                after = self.steps[state].get(c)
                if after is None:
                    now, filled = self._step(self.states[state], c), len(self.states) < STATES
                    after = self._number(now) if now else -1
                    if filled:
                        self.steps[state][c] = after
                state = after
            elif at < 0:
                break
        best = max(best, self.exact.get(at, 0.0))
        if best or state < 0:
            return (best, 0.0) if best else NO_MATCH
        near = 0.0
        if word not in self.clean:
            near = max((self.fuzzy[n] for n, cost in self.states[state] if cost and n in self.fuzzy), default=0.0)
        if self.brief is None or word in self.brief:
            near = max([near, *(self.short[n] for n, cost in self.states[state] if cost and n in self.short)])
        return (0.0, near) if near else NO_MATCH


@lru_cache(maxsize=2)
def _shared(terms: tuple[tuple[str, float], ...], clean: frozenset[str], brief: frozenset[str] | None) -> Lexicon:
    """A worker's own lexicon, built once for all of its tasks."""
    return Lexicon(dict(terms), clean, brief)


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the opening and the closing mark of each quotation, in order. An empty line ends what is open."""
    pairs, at, closing = [], -1, ""
    for m in MARK.finditer(text):
        mark = m.group()
        if closing and mark in closing:
            pairs.append((at, m.start()))
            closing = ""
        elif mark[0] == "\n":
            closing = ""
        elif not closing and mark in CLOSED_BY:
            at, closing = m.start(), CLOSED_BY[mark]
    return pairs


def _is_quoted(k: int, a: int, pairs: list[tuple[int, int]], opened: list[int], words: list[tuple[str, int, int]], starts: list[int]) -> bool:
    """Whether word ``k`` at ``a`` stands in a quotation of a few words, or in one with a word of reporting beside it."""
    n = bisect_right(opened, a) - 1
    if n < 0 or pairs[n][1] < a:
        return False
    first, after = bisect_left(starts, pairs[n][0]), bisect_left(starts, pairs[n][1])  # the words inside
    if k - first < CONTEXT and after - k <= CONTEXT:
        return True
    return any(w in REPORTING for w, _, _ in words[max(0, first - CONTEXT) : first] + words[after : after + CONTEXT])


def features(text: str, lexicon: Lexicon) -> tuple[float, float, float, float, float]:
    """Weight of meant hits, of misspelt ones and of quoted ones, the greatest meant weight, and hits by the word."""
    if not any(map(any, map(lexicon.match, set(map(str.lower, WORD.findall(text)))))):
        return NO_HITS
    words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    hits = []
    for k, (w, a, b) in enumerate(words):
        exact, near = lexicon.match(w)
        if exact or near:
            hits.append((k, a, exact, near))
    pairs = quotations(text)
    opened, starts = [p[0] for p in pairs], [w[1] for w in words]
    meant = misspelt = quoted = top = 0.0
    for k, a, exact, near in hits:
        if _is_quoted(k, a, pairs, opened, words, starts):
            quoted += exact or near
        elif exact:
            meant += exact
            top = max(top, exact)
        else:
            misspelt += near
    return math.log1p(meant), math.log1p(misspelt), math.log1p(quoted), top, len(hits) / max(len(words), 1)


def learn_terms(labelled: DataFrame) -> dict[str, float]:
    """Log-odds of the words and stems most typical of ``labelled(text, toxic)`` rows that are toxic.

    Counts every labelled row: in how many of the toxic and of the clean texts a word occurs, from
    those the same for stems. As an entry stands in at least one of ``RARE`` toxic texts, there are
    at most ``RARE`` times as many entries as a toxic text has words and stems on average, however many
    texts there are; all of them are kept.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), WORDS_SQL))
    totals = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    pos, neg = totals[0] or 0, totals[1] or 0
    if not pos or not neg:
        return {}
    counted = (
        labelled.select(F.explode(words).alias("w"), F.col("toxic").cast("long").alias("t")).where("w <> ''")
        .groupBy("w").agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n"))
    )
    spans = F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length("w") - 1))
    stems = F.when(F.length("w") > STEMS[0], F.transform(spans, lambda k: F.concat(F.substring(F.col("w"), F.lit(1), k), F.lit("*"))))
    entries = F.concat(F.array("w"), F.coalesce(stems, F.array().cast("array<string>")))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    best = (
        counted.select(F.explode(entries).alias("term"), "p", "n").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .where(F.col("p") >= max(LEAST, -(-pos // RARE))).withColumn("odds", F.round(odds, 9)).where(f"odds >= {TYPICAL} AND length(term) >= 3")
    )
    return {r.term: r.odds for r in best.collect()}


def judged_neighbours(labelled: DataFrame, terms: dict[str, float]) -> tuple[frozenset[str], frozenset[str]]:
    """Words near an entry that are words of their own, and misspellings of short entries that count as such.

    Each is judged by the log-odds of the toxic and the clean labelled texts that hold it, so a single
    clean text does not outweigh the rest. Both sets are bounded by the lexicon's neighbours.
    """
    every, long_ones = Lexicon(terms, brief=None), Lexicon(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [
                (w, bool(long_ones.match(w)[1]), toxic)
                for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for w in {m.group().lower() for m in WORD.finditer(t or "")} if every.match(w)[1]
            ]
            words, kinds, toxic = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(kinds, pa.bool_()), pa.array(toxic, pa.int64())], ["w", "long", "t"])

    if not every.fuzzy and not every.short:
        return frozenset(), frozenset()
    pos, neg = (n or 0 for n in labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    found = labelled.select("text", F.col("toxic").cast("long").alias("t")).mapInArrow(run, "w string, long boolean, t long")
    p, n = F.sum("t") + 0.5, F.sum(1 - F.col("t")) + 0.5
    odds = F.log(p / (pos + 1.0)) - F.log(n / (neg + 1.0))
    judged = found.groupBy("w", "long").agg(odds.alias("odds"), F.sqrt(1 / p + 1 / n).alias("error"))
    rows = judged.where(F.when(F.col("long"), F.col("odds") + F.col("error") < OWN_WORD).otherwise(F.col("odds") >= TYPICAL)).select("w", "long").collect()
    return frozenset(r.w for r in rows if r.long), frozenset(r.w for r in rows if not r.long)


FEATURES = ["meant", "misspelt", "quoted", "top", "share"]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, found: tuple[float, ...]) -> float:
        z = float(np.dot(self.weights[:-1], found) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, toxic)`` on ``docs(doc_id, text)``, from rows that are not held out.

    Rows without a toxic label, without a doc_id or held out teach nothing. With no toxic or no
    clean row the score is the share of toxic rows everywhere (0 if there are no labels).
    """
    taught = cut(
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = taught.count()
    rows = docs.select("doc_id", "text")
    labelled = rows.join(F.broadcast(taught), "doc_id") if n <= SENT_LABELS else cut(rows.join(taught, "doc_id"))
    terms = learn_terms(labelled)
    lexicon = Lexicon(terms, *judged_neighbours(labelled, terms))
    # The fitted rows are found by the hashes of their ids alone, so no text is sorted.
    last = labelled.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    taught_rows = labelled.where(F.xxhash64("doc_id") <= (last if last is not None else 0))
    model = Model(lexicon, np.zeros(len(FEATURES) + 1))
    ship_features = _features(taught_rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), model)
    got = np.array([tuple(r) for r in ship_features.select(*FEATURES, "toxic").collect()], float).reshape(-1, len(FEATURES) + 1)
    y = got[:, -1]
    if len(y) and 0 < y.sum() < len(y):
        model.weights = _fit(got[:, :-1], y)
        # Misspelt words are abuse as much as right ones, even where no labelled text has any.
        model.weights[1] = max(model.weights[1], 0.6 * model.weights[0])
    else:
        share = float(y.mean()) if len(y) else 0.0
        model.weights[-1] = math.log((share + 1e-6) / (1 - share + 1e-6))
    return model


def _features(docs: DataFrame, model: Model) -> DataFrame:
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [features(t or "", model.lexicon) for t in batch.column(where).to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(len(FEATURES))]
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *cols], [*(n for _, n in kept), *FEATURES])

    schema = docs.drop("text").select("*", *[F.lit(0.0).alias(f) for f in FEATURES]).schema
    return docs.mapInArrow(run, schema)


def with_scores(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with a double ``column`` from 0 to 1. Null and empty texts get the score of no hits; all columns and rows stay."""
    where = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in pieces(batches):
            got = [learned.score(features(t or "", learned.lexicon)) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; a null doc_id is not held out."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels), "score").drop("text")
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``at_least``; all columns stay."""
    column = "_score"
    while column in docs.columns:
        column += "_"
    return with_scores(docs, fit(docs, labels), column).where(F.col(column) < at_least).select(*docs.columns)
