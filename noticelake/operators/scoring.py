"""Match scoring of (firm, notice) pairs.

The whole of a pair's score comes from a few joins: its preferences by firm, its notice by id, the
points of its firm for its buyer, and one tile join by firm that reduces capabilities and the values
of past wins to a few numbers per pair. Hard filters run before any vector is touched, and notice
texts stay where they are: only codes of the words found in them meet the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions import display, vector as vx
from noticelake.operators import mentions, tiles
from noticelake.operators.lists import PAGE_ROWS, paged_lists
from noticelake.operators.vectors import rows_above, search_notices
from noticelake.session import staged

# Weights, steps and limits of the scores.
WEIGHTS = {"capability": 0.4, "past_win": 0.3, "preference": 0.3}
TOP_CAPABILITIES = 3
EQUAL_BUYER, SIMILAR_BUYER, SIMILAR_VALUE = 0.6, 0.4, 0.3
VALUE_RATIO, REASON_RATIO = 0.5, 0.8
REGION_BONUS, REGION_FACTOR, KEYWORD_BONUS = 0.2, 0.6, 0.15
CAPABILITY_BANDS = ((0.6, "Strong"), (0.4, "Good"), (0.25, "Moderate"))
REASON_KEYWORDS = 3
QUERY_CAPABILITIES = 3


# ---- preferences ---------------------------------------------------------------------------------


def given(number: Column) -> Column:
    """Present and not zero."""
    return F.coalesce(number != 0, F.lit(False))


def listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def preference_columns(says: Callable[[Column], Column]) -> dict[str, Column]:
    """Score, hard-filter flag and reason parts from joined notice and preference columns and the
    ``keyword_hits`` in the notice's text; ``says`` tells whether a word stands in that."""
    value = F.col("value").cast("double")
    low, high = F.col("min_contract_value").cast("double"), F.col("max_contract_value").cast("double")
    outside = given(value) & ((given(low) & (value < low)) | (given(high) & (value > high)))
    excluded = F.exists(listed("excluded_categories"), says)
    regions = listed("preferred_regions")
    located = (F.length("region") > 0) & (F.size(regions) > 0)
    in_region = located & F.array_contains(regions, F.col("region"))
    base = F.when(in_region, F.lit(1.0) + REGION_BONUS).when(located, F.lit(1.0) * REGION_FACTOR).otherwise(1.0)
    hits = F.col("keyword_hits")
    score = F.least(base + F.size(hits) * F.lit(KEYWORD_BONUS), F.lit(1.0))
    set_up = F.coalesce(F.col("has_preferences"), F.lit(False))
    ranged = set_up & given(value) & (given(low) | given(high))
    reasons = F.array(
        F.when(ranged, F.concat(F.lit("Contract value ("), display.money(value), F.lit(") matches preferences"))),
        F.when(set_up & in_region, F.concat(F.lit("Located in preferred region ("), F.col("region"), F.lit(")"))),
        F.when(
            set_up & (F.size(hits) > 0),
            F.concat(F.lit("Matches keywords: "), F.array_join(F.slice(hits, 1, REASON_KEYWORDS), ", ")),
        ),
    )
    return {
        "preference_score": F.when(set_up, score).otherwise(1.0),
        "rejected": F.coalesce(set_up & (outside | excluded), F.lit(False)),
        "preference_reasons": F.filter(reasons, lambda r: r.isNotNull()),
    }


def _stated(preferences: DataFrame) -> DataFrame:
    return preferences.select(
        "firm_id", "min_contract_value", "max_contract_value", "preferred_regions", "excluded_categories", "keywords",
        F.lit(True).alias("has_preferences"),
    )


def with_preferences(pairs: DataFrame, notices: DataFrame, preferences: DataFrame, firms: DataFrame | None = None) -> DataFrame:
    """Pairs with their notice's buyer and value, the preference score, and ``rejected``.

    With ``firms`` (keyed by ``firm_id``) only pairs of those firms are kept, along with its columns: all
    that is known of a firm then meets the pairs in a single join.
    """
    stated = _stated(preferences)
    if firms is None:
        joined = pairs.join(stated, "firm_id", "left")
    else:
        joined = pairs.join(firms.join(stated, "firm_id", "left"), "firm_id")
    # Words are looked for where the texts are: pairs meet only the codes of those found.
    about = notices.select("notice_id", "buyer_name", "value", "region", search_text().alias("search_text"))
    found, says = mentions.mentioned(about, "search_text", stated_words(preferences)), mentions.says
    if found is None:
        # More words than a task can hold: texts, lower-cased once, meet the pairs and leave the rows right after.
        found, says = about.withColumn("search_text", F.lower("search_text")), lambda w: F.col("search_text").contains(F.lower(w))
    hits = F.filter(listed("keywords"), says)
    searched = joined.join(found, "notice_id").withColumn("keyword_hits", hits).withColumns(preference_columns(says))
    return searched.drop(*[c for c in stated.columns if c != "firm_id"], "search_text", "mentioned", "keyword_hits")


def search_text() -> Column:
    return F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")))


def stated_words(preferences: DataFrame) -> DataFrame:
    """All words that preferences look for in a notice's text, as ``word``."""
    return preferences.select(F.explode(F.concat(listed("keywords"), listed("excluded_categories"))).alias("word"))


# ---- capabilities and past wins ------------------------------------------------------------------


# Wins beyond these numbers cannot move a score that is capped at 1: four similar values, or three
# wins with one buyer name, are worth more than 1 already.
ENOUGH_VALUES, ENOUGH_BUYERS = 4, 3


def firm_evidence(capabilities: DataFrame | None, wins: DataFrame | None) -> DataFrame:
    """What pairs are scored against, as one compact table keyed by firm. Exact for scoring, and bounded
    where a firm's history is not:

    * of capabilities with one and the same vector, as many as an average can take;
    * of wins with one buyer name, a count, held at the number that is enough for the cap;
    * of positive win values in one power of two, the lowest and highest few. A range of values either spans
      the bucket or cuts it on one side, and either way these show whether enough values lie inside;
    * of negative win values, a few: two negative values always count as alike, as their ratio is 1 or more.

    Everything is reduced before it is shuffled by firm. Scoring takes the result as ``evidence``, so it
    can be kept as a table.
    """
    parts = []
    if capabilities is not None:
        same = Window.partitionBy("firm_id", F.xxhash64("embedding"), F.xxhash64(F.reverse("embedding"))).orderBy("capability_id")
        held = capabilities.where("embedding is not null").select("firm_id", "capability_id", "embedding")
        kept = held.withColumn("n", F.row_number().over(same)).where(F.col("n") <= TOP_CAPABILITIES)
        parts.append(kept.selectExpr(
            "firm_id", "concat('c', capability_id) as rid", "embedding", "cast(null as string) as win_buyer",
            "0 as win_count", "cast(null as double) as win_value",
        ))
    if wins is not None:
        buyers = wins.select("firm_id", F.lower("buyer_name").alias("b")).where("b <> ''").groupBy("firm_id", "b").agg(
            F.least(F.count(F.lit(1)), F.lit(ENOUGH_BUYERS)).cast("int").alias("win_count")
        )
        parts.append(buyers.selectExpr(
            "firm_id", "concat('b', b) as rid", "cast(null as array<float>) as embedding", "b as win_buyer", "win_count",
            "cast(null as double) as win_value",
        ))
        worth = wins.selectExpr("firm_id", "cast(win_id as string) as win_id", "cast(contract_value as double) as v").where("v <> 0")
        bucket = value_bucket("v")
        low = Window.partitionBy("firm_id", bucket).orderBy("v", "win_id")
        high = Window.partitionBy("firm_id", bucket).orderBy(F.desc("v"), F.desc("win_id"))
        ends = [worth.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ENOUGH_VALUES).drop("n") for w in (low, high)]
        parts.append(ends[0].union(ends[1]).distinct().selectExpr(
            "firm_id", "concat('v', win_id) as rid", "cast(null as array<float>) as embedding", "cast(null as string) as win_buyer",
            "0 as win_count", "v as win_value",
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The bucket of all negative values; powers of two of doubles are far above it.
NEGATIVE = -100_000


def value_bucket(value) -> Column:
    """The power of two that a positive value lies in, and one bucket for all negative ones. Values of one
    bucket are always alike, values two or more buckets apart never."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value > 0, F.floor(F.log2(value)).cast("int")).when(value < 0, F.lit(NEGATIVE))


def alike(worth: np.ndarray, value: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """For each value, the span of the sorted ``worth`` where the smaller over the larger passes ``ratio``.

    Of two positive values that is the usual ratio. Of two negative ones it is 1 or more, so all
    negative worths count; values of unlike signs never do.
    """
    start = np.searchsorted(worth, value * ratio, "right")
    end = np.searchsorted(worth, value / ratio, "left")
    negative = value < 0
    start[negative], end[negative] = 0, np.searchsorted(worth, 0.0)
    missing = np.isnan(value)
    start[missing] = end[missing] = 0
    return start, np.maximum(start, end)


_PARTIAL = "firm_id string, notice_id string, preference_score double, sims array<double>, points double"


def _best_similarities(a: pa.Table, b: pa.Table) -> pa.Array:
    """For each row of ``a``, its highest cosines with the rows of ``b``, a list of as many as an average takes at most."""
    rows, _, cos = tiles.cosines(a, b)
    top = min(TOP_CAPABILITIES, cos.shape[1])
    best = np.partition(cos, cos.shape[1] - top, axis=1)[:, cos.shape[1] - top :] if top else np.zeros((len(rows), 0))
    length = np.zeros(a.num_rows, dtype=np.int64)
    length[rows] = top
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(best.ravel()))


def _score_tile(a: pa.Table, b: pa.Table) -> dict:
    """Best similarities and value points of each pair, from one block of its firm's evidence."""
    worth = tiles.numbers(b.column("win_value"))
    start, end = alike(np.sort(worth[~np.isnan(worth)]), tiles.numbers(a.column("value")), VALUE_RATIO)
    points = SIMILAR_VALUE * (end - start)
    return {
        "firm_id": a.column("firm_id"), "notice_id": a.column("notice_id"), "preference_score": a.column("preference_score"),
        "sims": _best_similarities(a, b), "points": points,
    }


def score_pairs(
    pairs: DataFrame,
    notices: DataFrame,
    notice_vectors: DataFrame,
    firms: DataFrame,
    capabilities: DataFrame,
    past_wins: DataFrame,
    preferences: DataFrame,
    block: int = tiles.RIGHT_BLOCK,
    evidence: DataFrame | None = None,
    judged: DataFrame | None = None,
) -> DataFrame:
    """Component and total scores per pair. Rejected pairs and firms without a profile are absent.

    ``evidence`` is a stored :func:`firm_evidence` of the capabilities and past wins, ``judged`` a stored
    :func:`with_preferences` of the pairs, if there is one.
    """
    pairs = pairs.select("firm_id", "notice_id")
    if evidence is None:
        # Counted for the tiles and then joined; written once, it is not reduced twice.
        evidence = staged(firm_evidence(capabilities, past_wins), "firm-evidence")
    weighed = evidence.where("win_buyer IS NULL")
    sizes = staged(tiles.tile_sizes(pairs, weighed, ["firm_id"], block, block), "tile-sizes")
    known = firms.select("firm_id").join(sizes, "firm_id")
    met = with_preferences(pairs, notices, preferences, known) if judged is None else judged.join(known, "firm_id")
    # Read for the tiles, the buyers and the points; written once, no text is searched twice.
    passed = staged(
        met.where(~F.col("rejected")).select(
            "firm_id", "notice_id", "buyer_name", F.col("value").cast("double").alias("value"), "preference_score", "_lb", "_rb"
        ),
        "passed-pairs",
    )
    left = passed.drop("buyer_name").join(notice_vectors.select("notice_id", "embedding"), "notice_id", "left")
    partial = tiles.tile_join(
        left, weighed, ["firm_id"], ["notice_id"], ["rid"], _score_tile, _PARTIAL,
        left_block=block, right_block=block, sizes=sizes,
    )
    return total_score(merge_partials(partial, with_buyer_points(passed, evidence)))


def with_buyer_points(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(firm_id, notice_id, buyer_points)`` of the pairs whose firm has won with the notice's buyer or a similar one."""
    named = pairs.select("firm_id", "notice_id", F.lower("buyer_name").alias("buyer")).where("buyer <> ''")
    return named.join(_points_by_buyer(named, evidence), ["firm_id", "buyer"]).select("firm_id", "notice_id", "buyer_points")


def _points_by_buyer(named: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(firm_id, buyer, buyer_points)`` of the firms and lower-case buyers in ``named`` that are related.

    Buyers are related once for each name, then met by (firm, buyer): equi-joins on distinct names,
    whatever the number of notices of a buyer or of wins of a firm.
    """
    asked = named.select("firm_id", "buyer").where("buyer <> ''").distinct()
    related, held = _related_wins(asked.select(F.col("buyer").alias("buyer_name")), evidence)
    return _summed_points(asked.join(related, "buyer").join(held, ["firm_id", "win_buyer"]))


def points_by_firm(notices: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(firm_id, buyer, buyer_points)`` of every firm and lower-case buyer of ``notices`` that are related."""
    related, held = _related_wins(notices.select("buyer_name"), evidence)
    return _summed_points(held.join(related, "win_buyer"))


def _related_wins(buyers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = evidence.where("win_buyer IS NOT NULL").select("firm_id", "win_buyer", "win_count")
    return buyer_similarity(buyers, held.select(F.col("win_buyer").alias("buyer_name"))), held


def _summed_points(met: DataFrame) -> DataFrame:
    worth = F.when(F.col("kind") == "equal", EQUAL_BUYER).otherwise(SIMILAR_BUYER)
    return met.groupBy("firm_id", "buyer").agg(F.sum(worth * F.col("win_count")).alias("buyer_points"))


def merge_partials(partial: DataFrame, buyer_points: DataFrame) -> DataFrame:
    """Scores of the tiles of a pair and its points for the buyer put together; each tile brings at most three similarities."""
    points = buyer_points.select(
        "firm_id", "notice_id", F.lit(None).cast("double").alias("preference_score"), F.array().cast("array<double>").alias("sims"),
        F.col("buyer_points").alias("points"),
    )
    merged = partial.unionByName(points).groupBy("firm_id", "notice_id").agg(
        F.max("preference_score").alias("preference_score"),
        F.least(F.sum("points"), F.lit(1.0)).alias("past_win_score"),
        _top_of("sims").alias("top"),
    )
    return merged.withColumn("capability_score", average("top")).drop("top")


def _top_of(sims: str) -> Column:
    """The highest similarities of all tiles of a pair."""
    return F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(sims)))), 1, TOP_CAPABILITIES)


def average(values: str) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def total_score(scored: DataFrame) -> DataFrame:
    total = (
        F.col("capability_score") * WEIGHTS["capability"]
        + F.col("past_win_score") * WEIGHTS["past_win"]
        + F.col("preference_score") * WEIGHTS["preference"]
    )
    return scored.select(
        "firm_id", "notice_id", "capability_score", "past_win_score", "preference_score", total.alias("total_score")
    )


def _vector_sides(pairs: DataFrame, notice_vectors: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with their notice's vector, capabilities with one, and their tile sizes, which pairs carry
    before they get a vector: vectors are then shuffled once, to their tile."""
    named = pairs.select("firm_id", "notice_id")
    right = capabilities.where("embedding is not null").select("firm_id", "capability_id", "embedding")
    # Joined to both sides; written once, they are not counted twice.
    sizes = staged(tiles.tile_sizes(named, right, ["firm_id"]), "tile-sizes")
    left = named.join(sizes, "firm_id").join(notice_vectors.select("notice_id", "embedding").where("embedding is not null"), "notice_id")
    return left, right, sizes


def capability_top(pairs: DataFrame, notice_vectors: DataFrame, capabilities: DataFrame, k: int = TOP_CAPABILITIES) -> DataFrame:
    """The ``k`` most similar capabilities of each pair: ``(firm_id, notice_id, capability_id, similarity)``."""
    left, right, sizes = _vector_sides(pairs, notice_vectors, capabilities)
    kind = dict(capabilities.dtypes)["capability_id"]

    def best(a: pa.Table, b: pa.Table) -> dict | None:
        rows, cols, cos = tiles.cosines(a, b)
        if not cos.size:
            return None
        ident = tiles.pick(b.column("capability_id"), cols).to_numpy(zero_copy_only=False)
        row, col = tiles.top_cells(cos, ident, k)
        return {
            "firm_id": tiles.pick(a.column("firm_id"), rows[row]),
            "notice_id": tiles.pick(a.column("notice_id"), rows[row]),
            "capability_id": tiles.pick(b.column("capability_id"), cols[col]),
            "similarity": cos[row, col],
        }

    found = tiles.tile_join(
        left, right, ["firm_id"], ["notice_id"], ["capability_id"], best,
        f"firm_id string, notice_id string, capability_id {kind}, similarity double", sizes=sizes,
    )
    w = Window.partitionBy("firm_id", "notice_id").orderBy(F.desc(F.round("similarity", vx.RANK_DIGITS)), "capability_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def capability_score(pairs: DataFrame, notice_vectors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Mean of the up to three best similarities; 0 for a pair with a missing side."""
    left, right, sizes = _vector_sides(pairs, notice_vectors, capabilities)

    def best(a: pa.Table, b: pa.Table) -> dict:
        sims = _best_similarities(a, b)
        return {"firm_id": a.column("firm_id"), "notice_id": a.column("notice_id"), "sims": sims}

    found = tiles.tile_join(
        left, right, ["firm_id"], ["notice_id"], ["capability_id"], best, "firm_id string, notice_id string, sims array<double>", sizes=sizes,
    )
    best = found.groupBy("firm_id", "notice_id").agg(_top_of("sims").alias("top")).select(
        "firm_id", "notice_id", average("top").alias("capability_score")
    )
    scored = pairs.select("firm_id", "notice_id").join(best, ["firm_id", "notice_id"], "left")
    return scored.withColumn("capability_score", F.coalesce("capability_score", F.lit(0.0)))


def past_win_score(pairs: DataFrame, notices: DataFrame, past_wins: DataFrame, block: int = tiles.LEFT_BLOCK) -> DataFrame:
    """Points of each pair for its firm's wins, at most 1.

    A firm's win values, bounded by :func:`firm_evidence`, meet its pairs as one list. Pairs of a firm with more
    than ``block`` of them are dealt out by notice, and only their firm's list is repeated.
    """
    about = notices.select("notice_id", F.lower("buyer_name").alias("buyer"), F.col("value").cast("double").alias("value"))
    named = staged(pairs.select("firm_id", "notice_id").join(about, "notice_id").where("firm_id IS NOT NULL"), "named-pairs")
    evidence = staged(firm_evidence(None, past_wins), "firm-evidence")
    # One row for each firm that fills more than a block.
    count = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int")
    large = staged(named.groupBy("firm_id").agg(count.alias("_lb")).where("_lb > 1"), "large-firms")
    # As in a tile, values that are not finite are like no other.
    finite = F.abs("win_value") < F.lit(float("inf"))
    worths = evidence.where(finite).groupBy("firm_id").agg(F.collect_list("win_value").alias("worth"))
    dealt = F.coalesce("_lb", F.lit(1))
    lists = worths.join(large, "firm_id", "left").withColumn("_l", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("_lb")
    met = named.join(_points_by_buyer(named, evidence), ["firm_id", "buyer"], "left").join(large, "firm_id", "left").withColumn(
        "_l", F.pmod(F.xxhash64("notice_id"), dealt).cast("int")
    ).drop("_lb").join(lists, ["firm_id", "_l"], "left")
    value = F.col("value")
    alike = lambda w: F.when(value < 0, w < 0).otherwise((w > value * VALUE_RATIO) & (w < value / VALUE_RATIO))
    similar = F.when((F.abs(value) < F.lit(float("inf"))) & (value != 0), F.size(F.filter("worth", alike))).otherwise(0)
    # The part a pair was dealt to follows from the pair, so it makes no more groups, and no shuffle.
    return met.groupBy("firm_id", "_l", "notice_id").agg(
        F.sum(F.coalesce(SIMILAR_VALUE * F.when(F.col("worth").isNotNull(), similar), F.lit(0.0))).alias("_values"),
        F.coalesce(F.sum("buyer_points"), F.lit(0.0)).alias("_buyers"),
    ).select("firm_id", "notice_id", F.least(F.col("_values") + F.col("_buyers"), F.lit(1.0)).alias("past_win_score"))


# ---- reasons -------------------------------------------------------------------------------------


def capability_reason(score="capability_score") -> Column:
    score = F.col(score)
    text = lambda word: F.concat(F.lit(f"{word} capability match ("), display.percent_text(score), F.lit(")"))
    (a, strong), (b, good), (c, moderate) = CAPABILITY_BANDS
    return F.when(score > a, text(strong)).when(score > b, text(good)).when(score > c, text(moderate))


def _value_hits(worth: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs and of wins whose values give a reason."""
    order = np.argsort(worth)[: np.count_nonzero(~np.isnan(worth))]
    # A slightly lower ratio on the sorted values first, then the exact test on what it holds.
    start, end = alike(worth[order], value, REASON_RATIO * (1 - 1e-9))
    rows, at = _spans(start, end - start)
    cols = order[at]
    near = np.minimum(value[rows], worth[cols]) / np.maximum(value[rows], worth[cols]) > REASON_RATIO
    return rows[near], cols[near]


def _spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number, once for each place of its span, and the places from ``start`` on."""
    return np.repeat(np.arange(len(count)), count), np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _reason_tile(a: pa.Table, b: pa.Table) -> dict | None:
    """The wins of one block whose value gives a pair a reason."""
    worth = tiles.numbers(b.column("win_value"))
    rows, cols = _value_hits(worth, tiles.numbers(a.column("value")))
    if not len(rows):
        return None
    return {
        "firm_id": tiles.pick(a.column("firm_id"), rows),
        "notice_id": tiles.pick(a.column("notice_id"), rows),
        "win_id": tiles.pick(b.column("win_id"), cols),
        "win_value": worth[cols],
    }


def win_reasons(pairs: DataFrame, notices: DataFrame, past_wins: DataFrame) -> DataFrame:
    """One row per reason a past win gives a pair, with ``win_id`` and ``kind`` as its place in order:
    equal buyer (1), similar buyer (2), value (3)."""
    about = notices.select("notice_id", F.lower("buyer_name").alias("buyer"), F.col("value").cast("double").alias("value"))
    left = staged(pairs.select("firm_id", "notice_id").join(about, "notice_id"), "reason-pairs")
    wins = past_wins.select(
        "firm_id", F.col("win_id").cast("string").alias("win_id"), "buyer_name", F.lower("buyer_name").alias("win_buyer"),
        F.col("contract_value").cast("double").alias("win_value"),
    )
    named = left.where("buyer <> ''")
    related = buyer_similarity(named.select(F.col("buyer").alias("buyer_name")), wins.select(F.col("win_buyer").alias("buyer_name")))
    # Names are related per firm first, so a pair meets only the wins that give it a reason.
    known = named.select("firm_id", "buyer").distinct().join(related, "buyer")
    met = named.join(known.join(wins, ["firm_id", "win_buyer"]), ["firm_id", "buyer"])
    buyers = met.select(
        "firm_id", "notice_id", "win_id", F.when(F.col("kind") == "equal", 1).otherwise(2).alias("kind"),
        F.when(F.col("kind") == "equal", F.concat(F.lit("Previously won contract with "), "buyer_name"))
        .otherwise(F.concat(F.lit("Previously worked with similar buyer ("), "buyer_name", F.lit(")"))).alias("reason"),
    )
    values = tiles.tile_join(
        left.where("value <> 0").select("firm_id", "notice_id", "value"), wins.where("win_value <> 0").select("firm_id", "win_id", "win_value"),
        ["firm_id"], ["notice_id"], ["win_id"], _reason_tile, "firm_id string, notice_id string, win_id string, win_value double",
    )
    return buyers.unionByName(values.select(
        "firm_id", "notice_id", "win_id", F.lit(3).alias("kind"),
        F.concat(F.lit("Similar contract value to past win ("), display.money("win_value"), F.lit(")")).alias("reason"),
    ))


def reason_rows(
    scored: DataFrame, notices: DataFrame, past_wins: DataFrame, preferences: DataFrame, judged: DataFrame | None = None
) -> DataFrame:
    """All reasons of scored pairs in long form: ``(firm_id, notice_id, part, win_id, kind, reason)``.

    Ordering by ``(part, win_id, kind)`` gives the list order: capability, wins, preferences. ``judged`` is a
    stored :func:`with_preferences` of the pairs that were scored, if there is one.
    """
    key = ["firm_id", "notice_id"]
    place = lambda part, win, kind: (F.lit(part).alias("part"), win.alias("win_id"), kind.cast("int").alias("kind"))
    cap = scored.select(*key, *place(1, F.lit(""), F.lit(0)), capability_reason().alias("reason")).where("reason is not null")
    wins = win_reasons(scored, notices, past_wins).select(*key, *place(2, F.col("win_id"), F.col("kind")), "reason")
    if judged is None:
        stated = with_preferences(scored.select(*key), notices, preferences)
    else:
        # Rejected pairs have no score.
        stated = judged.join(scored.select(*key), key, "left_semi")
    prefs = stated.select(
        *key, F.posexplode("preference_reasons").alias("kind", "reason")
    ).select(*key, *place(3, F.lit(""), F.col("kind")), "reason")
    return cap.unionByName(wins).unionByName(prefs)


#: Firms of at most this many wins have their lists made in tiles, of at most this many pairs.
LISTED_WINS, LISTED_PAIRS = 2048, 1024


def with_reasons(
    scored: DataFrame, notices: DataFrame, past_wins: DataFrame, preferences: DataFrame, judged: DataFrame | None = None
) -> DataFrame:
    """Scored pairs with their ``match_reasons``, in order.

    A pair with more reasons than a page holds gets further rows, numbered by ``reasons_page``, so that
    no list grows with the firm's history; :func:`reason_rows` has the same reasons as rows, and says what
    ``judged`` is. A pair's list is made where its firm's wins are, in one tile; only the lists of firms with very many wins
    are gathered from rows.
    """
    # Read for every kind of reason and for the lists; written once, pairs are not scored once for each.
    scored = staged(scored, "scored-pairs")
    if judged is None:
        # Texts of other notices are not searched.
        notices = notices.join(scored.select("notice_id").distinct(), "notice_id", "left_semi")
    # One row for each such firm.
    many = staged(past_wins.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LISTED_WINS).select("firm_id"), "many-wins")
    if not many.limit(1).count():
        return _listed_in_tiles(scored, notices, past_wins, preferences, judged)
    few = _listed_in_tiles(scored.join(many, "firm_id", "left_anti"), notices, past_wins.join(many, "firm_id", "left_anti"), preferences, judged)
    return few.unionByName(_listed_from_rows(scored.join(many, "firm_id", "left_semi"), notices, past_wins, preferences, judged).select(few.columns))


def _listed_from_rows(scored: DataFrame, notices: DataFrame, past_wins: DataFrame, preferences: DataFrame, judged: DataFrame | None) -> DataFrame:
    key = ["firm_id", "notice_id"]
    # Counted and listed; written once, the reasons are not looked for twice.
    rows = staged(reason_rows(scored, notices, past_wins, preferences, judged), "match-reasons")
    lists = paged_lists(rows, key, ["part", "win_id", "kind", "reason"], "match_reasons", "reasons_page")
    texts = F.transform("match_reasons", lambda r: r["reason"])
    listed = scored.join(lists, key, "left").withColumn("match_reasons", texts)
    empty = F.array().cast("array<string>")
    return listed.withColumns(
        {"match_reasons": F.coalesce("match_reasons", empty), "reasons_page": F.coalesce("reasons_page", F.lit(0))}
    )


def _listed_in_tiles(scored: DataFrame, notices: DataFrame, past_wins: DataFrame, preferences: DataFrame, judged: DataFrame | None) -> DataFrame:
    key = ["firm_id", "notice_id"]
    if judged is None:
        judged = with_preferences(scored.select(*key), notices, preferences)
    own = F.transform("preference_reasons", lambda r, k: F.struct(k.alias("kind"), r.alias("reason")))
    stated = judged.where(F.size("preference_reasons") > 0).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list(own))).alias("s"))
    stated = stated.select(*key, F.transform("s", lambda r: r["reason"]).alias("_stated"))
    about = notices.select("notice_id", F.lower("buyer_name").alias("_buyer"), F.col("value").cast("double").alias("_value"))
    wins = past_wins.select(
        "firm_id", F.col("win_id").cast("string").alias("win_id"), "buyer_name", F.lower("buyer_name").alias("win_buyer"),
        F.col("contract_value").cast("double").alias("win_value"), display.money(F.col("contract_value").cast("double")).alias("worth"),
    )
    sizes = staged(tiles.tile_sizes(scored, wins, ["firm_id"], LISTED_PAIRS, LISTED_WINS), "tile-sizes")
    keyed = scored.where("firm_id IS NOT NULL AND notice_id IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    met = keyed.withColumn("_capability", capability_reason()).join(stated, key, "left").join(sizes, "firm_id").join(about, "notice_id", "left")
    made, size = scored.schema.names, PAGE_ROWS

    def listed(a: pa.Table, b: pa.Table) -> dict:
        rows, pages, lists = _reason_lists(a, b, size)
        return {c: tiles.pick(a.column(c), rows) for c in made} | {"match_reasons": lists, "reasons_page": pa.array(pages, pa.int32())}

    schema = ", ".join([*(f"`{c}` {t}" for c, t in scored.dtypes), "match_reasons array<string>, reasons_page int"])
    lists = tiles.tile_join(met, wins, ["firm_id"], ["notice_id"], ["win_id"], listed, schema, sizes=sizes)
    # Pairs without a key have no reasons.
    rest = scored.where("firm_id IS NULL OR notice_id IS NULL").select("*", F.array().cast("array<string>").alias("match_reasons"), F.lit(0).alias("reasons_page"))
    return lists.unionByName(rest)


def _reason_lists(a: pa.Table, b: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pages of the reasons of each scored pair (``_row``) in ``a`` from all wins of its firm: rows of ``a``, page numbers, lists.

    Rows of one notice share their reasons, as repeated rows of a key do in :func:`reason_rows`.
    """
    notice = a.column("notice_id").combine_chunks().dictionary_encode()
    notice = (notice.combine_chunks() if isinstance(notice, pa.ChunkedArray) else notice).indices.to_numpy()
    scored = np.unique(a.column("_row").to_numpy(), return_index=True)[1]
    some = np.unique(notice, return_index=True)[1]

    rows, cols, kind = _buyer_hits(a, b)
    near, worth = _value_hits(tiles.numbers(b.column("win_value")), tiles.numbers(a.column("_value")))
    rows, cols, kind = np.r_[rows, near], np.r_[cols, worth], np.r_[kind, np.full(len(near), 3)]
    plain = lambda c: pc.fill_null(b.column(c), "").combine_chunks().cast(pa.string())
    join = lambda *parts: pc.binary_join_element_wise(*parts, "")
    texts = pa.concat_arrays([
        one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one for one in (
            join("Previously won contract with ", plain("buyer_name")), join("Previously worked with similar buyer (", plain("buyer_name"), ")"),
            join("Similar contract value to past win (", plain("worth"), ")"),
        )
    ])
    text = (kind - 1) * b.num_rows + cols
    # Wins in the order of their ids; equal ids by kind and text.
    place = (_ranks(plain("win_id"))[cols] * 4 + kind) * (len(texts) + 1) + _ranks(texts)[text]

    able = scored[a.column("_capability").is_valid().to_numpy()[scored]]
    capable = tiles.pick(a.column("_capability"), able)
    stated = tiles.pick(a.column("_stated"), some)
    own = np.repeat(notice[some], pc.fill_null(pc.list_value_length(stated), 0).to_numpy())
    pool = pa.concat_arrays([texts, capable, stated.flatten()])
    code = np.r_[notice[rows], notice[able], own]
    order = np.lexsort((np.r_[place + 1, np.zeros(len(able), np.int64), np.arange(len(own)) + (1 << 62)], code))
    text = np.r_[text, len(texts) + np.arange(len(able) + len(own))][order]

    number = np.bincount(code, minlength=len(some))
    start = np.cumsum(number) - number
    pages = np.maximum(1, -(-number // size))
    rows, page = _spans(np.zeros(len(scored), np.int64), pages[notice[scored]])
    low = start[notice[scored]][rows] + page * size
    length = np.minimum(number[notice[scored]][rows] - page * size, size)
    taken = pool.take(pa.array(text[_spans(low, length)[1]], pa.int64()))
    return scored[rows], page, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), taken)


def _ranks(column: pa.Array) -> np.ndarray:
    """Places of texts among the distinct ones."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()]


def _buyer_hits(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs and of wins whose buyers are equal (kind 1) or hold each other's name (2), by distinct names."""
    (ours, mine), (theirs, won) = tiles.names(a.column("_buyer")), tiles.names(b.column("win_buyer"))
    kinds = np.zeros((len(ours), len(theirs)), np.int8)
    for j, name in enumerate(theirs):
        if name:
            kinds[pc.match_substring(pa.array(ours, pa.string()), name).to_numpy(zero_copy_only=False), j] = 2
    for i, name in enumerate(ours):
        if name:
            kinds[i, pc.match_substring(pa.array(theirs, pa.string()), name).to_numpy(zero_copy_only=False)] = 2
            if name in theirs:
                kinds[i, theirs.index(name)] = 1
    of, win = np.nonzero(kinds[:, won]) if len(theirs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    number = np.bincount(of, minlength=len(ours))
    rows, at = _spans((np.cumsum(number) - number)[mine], number[mine])
    return rows, win[at], kinds[mine[rows], won[win[at]]].astype(np.int64)


def first_reason(scored: DataFrame, notices: DataFrame, past_wins: DataFrame, preferences: DataFrame) -> DataFrame:
    """The leading reason of each pair, as an aggregation that combines before its shuffle."""
    rows = reason_rows(scored, notices, past_wins, preferences)
    return rows.groupBy("firm_id", "notice_id").agg(
        F.min(F.struct("part", "win_id", "kind", "reason"))["reason"].alias("match_reason")
    )


# ---- ranked results ------------------------------------------------------------------------------


def rank_scored(scored: DataFrame, limit: int, owner: str = "firm_id") -> DataFrame:
    """Best ``limit`` rows per owner by total score; ties keep the semantic order, then the id."""
    w = Window.partitionBy(owner).orderBy(
        F.desc(F.round("total_score", vx.RANK_DIGITS)), F.desc("score"), F.asc("notice_id")
    )
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def capability_queries(capabilities: DataFrame) -> DataFrame:
    """Search text per firm: its first three capability texts, joined by a space.

    The three are kept by a window limit before anything is gathered.
    """
    w = Window.partitionBy("firm_id").orderBy("capability_id")
    first = capabilities.withColumn("n", F.row_number().over(w)).where(F.col("n") <= QUERY_CAPABILITIES)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "capability_text"))), lambda e: e["capability_text"])
    return first.groupBy("firm_id").agg(F.array_join(parts, " ").alias("query_text"))


def firm_notice_pairs(firms: DataFrame, notices: DataFrame, as_of: Column, salts: int = 8) -> DataFrame:
    """Firms with the notices published from their ``since`` on, up to ``as_of``.

    Each firm is listed under the days of its window and meets notices by day, an equi-join in place
    of a product of both tables. A day's notices are salted, so that a bulk load does not sit in one task.
    """
    day = lambda c: F.to_date(c)
    wanted = firms.where(F.col("since") <= as_of).select(
        "firm_id", "since", F.explode(F.sequence(day("since"), day(as_of))).alias("day")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = notices.where(F.col("published_date") <= as_of).select("notice_id", "published_date").withColumns(
        {"day": day("published_date"), "salt": F.pmod(F.xxhash64("notice_id"), F.lit(salts)).cast("int")}
    )
    met = wanted.join(held, ["day", "salt"])
    return met.where(F.col("published_date") >= F.col("since")).select("firm_id", "notice_id")


def candidate_pairs(
    notices: DataFrame, notice_vectors: DataFrame, evidence: DataFrame, threshold: float, block: int = tiles.LEFT_BLOCK
) -> DataFrame:
    """``(firm_id, notice_id)`` of every pair that can score ``threshold`` or more in total, each once.

    Preferences alone give at most their weight. A total above that needs points for past wins or a
    capability score, so a pair comes from one of three relations, and no product of the tables is formed:

    * the firm has won with the notice's buyer or a similar one (join by buyer);
    * it has a win of a similar value (join by power of two, against the lowest and highest win in it);
    * it has no such win, and a capability so near to the notice that capability and preferences suffice.

    Keys that fill a block (a frequent buyer, a common size of contract) are split over tasks.
    """
    if threshold <= WEIGHTS["preference"]:
        raise ValueError("pairs of no relation can reach a total that preferences alone give")
    about = notices.select("notice_id", F.lower("buyer_name").alias("buyer"), F.col("value").cast("double").alias("value"))
    won = evidence.where("win_buyer IS NOT NULL").select("firm_id", "win_buyer")
    named = about.where("buyer <> ''").select("notice_id", "buyer")
    related = buyer_similarity(named.select(F.col("buyer").alias("buyer_name")), won.select(F.col("win_buyer").alias("buyer_name")))
    known = won.join(related, "win_buyer").select("firm_id", "buyer").distinct()
    by_buyer = tiles.spread_join(known, named, ["buyer"], ["firm_id"], ["notice_id"], block).select("firm_id", "notice_id")

    spans = evidence.where("win_value IS NOT NULL").groupBy("firm_id", value_bucket("win_value").alias("held")).agg(
        F.min("win_value").alias("low"), F.max("win_value").alias("high")
    ).withColumn("bucket", F.explode(F.when(F.col("held") == NEGATIVE, F.array("held")).otherwise(F.array(*[F.col("held") + k for k in (-1, 0, 1)]))))
    valued = about.where("value <> 0").select("notice_id", "value", value_bucket("value").alias("bucket"))
    alike = (F.col("held") == F.col("bucket")) | F.when(
        F.col("held") > F.col("bucket"), F.col("low") * VALUE_RATIO < F.col("value")
    ).otherwise(F.col("high") > F.col("value") * VALUE_RATIO)
    by_value = tiles.spread_join(spans, valued, ["bucket"], ["firm_id", "held"], ["notice_id"], block).where(alike).select("firm_id", "notice_id")

    # Scores are compared after rounding, so the least cosine gives way by more than rounding can move a total.
    least = (threshold - WEIGHTS["preference"]) / WEIGHTS["capability"] - 1e-6
    asked = notice_vectors.join(notices.select("notice_id"), "notice_id", "left_semi")
    skills = evidence.where("embedding IS NOT NULL").select("rid", "firm_id", "embedding")
    by_vector = rows_above(asked, skills, least, "notice_id", "rid", "firm_id", block).select("firm_id", "notice_id")
    return by_buyer.union(by_value).union(by_vector).distinct()


GRAM = 3


def _grams(names: DataFrame, name: str, sizes: tuple[int, ...]) -> DataFrame:
    """``(name, gram)``: the distinct pieces of each name of the given sizes."""
    text = F.col(name)

    def parts_of(size: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substr(text, k, F.lit(size)))
        return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))

    return names.select(name, F.explode(F.array_distinct(F.concat(*map(parts_of, sizes)))).alias("gram"))


def contained_names(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)`` for all pairs of a name and another that holds it, equal ones too.

    An inner name is listed under its rarest piece of ``GRAM`` letters, counted over the outer names (a
    shorter name under itself); outer names look up their own pieces, and a hit is verified. Work
    grows with the length of names and with the rarest pieces' frequency, not with pairs of names.
    An inner name with a piece that no outer name has is dropped before the join.
    """
    pieces = staged(_grams(outer, "outer", tuple(range(1, GRAM + 1))), "name-pieces")
    often = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    short = inner.where(F.length("inner") < GRAM).select("inner", F.col("inner").alias("gram"))
    listed = _grams(inner, "inner", (GRAM,)).join(often, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")
    index = listed.groupBy("inner").agg(rarest).where("r.n > 0").select("inner", "r.gram").unionByName(short)
    return index.join(pieces, "gram").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def buyer_similarity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of distinct buyer names that are equal or contain each other, ignoring case:
    ``(buyer, win_buyer, kind)``. Empty and null names are like no other."""
    a = ours.select(F.lower("buyer_name").alias("a")).where("a <> ''").distinct()
    b = theirs.select(F.lower("buyer_name").alias("b")).where("b <> ''").distinct()
    inside = contained_names(b.withColumnRenamed("b", "inner"), a.withColumnRenamed("a", "outer"))
    around = contained_names(a.withColumnRenamed("a", "inner"), b.withColumnRenamed("b", "outer")).where(F.col("inner") != F.col("outer"))
    kind = F.when(F.col("inner") == F.col("outer"), "equal").otherwise("contains")
    return inside.select(F.col("outer").alias("buyer"), F.col("inner").alias("win_buyer"), kind.alias("kind")).union(
        around.select("inner", "outer", F.lit("contains"))
    )


def _narrowed(tables: dict[str, DataFrame], found: DataFrame) -> dict[str, DataFrame]:
    """The tables with only the notices found, so that no other text or vector is shuffled."""
    ids = found.select("notice_id").distinct()
    return tables | {name: tables[name].join(ids, "notice_id", "left_semi") for name in ("notices", "notice_vectors")}


def recommend_notices(
    queries: DataFrame, points: DataFrame, limit: int, tables: dict[str, DataFrame], **search
) -> DataFrame:
    """Best notices per firm: semantic search for twice the limit, then personal scores, then rank.

    ``queries`` holds ``(firm_id, embedding)``; firms without a query get nothing.
    """
    hits = search_notices(queries.withColumnRenamed("firm_id", "query_id"), points, 2 * limit, **search)
    # Counted, scored and ranked; written once, the search runs once.
    found = staged(hits.select(F.col("query_id").alias("firm_id"), "point_id", "score").join(
        points.select("point_id", "notice_id"), "point_id"
    ), "search-hits")
    scored = score_pairs(found, **_narrowed(tables, found))
    return rank_scored(scored.join(found.select("firm_id", "notice_id", "score"), ["firm_id", "notice_id"]), limit)


def personalised_search(
    requests: DataFrame, points: DataFrame, limit: int, tables: dict[str, DataFrame], scored: bool = True, **search
) -> DataFrame:
    """Requests ``(query_id, firm_id, embedding)`` to ranked notices; unscored mode keeps the semantic order."""
    hits = search_notices(requests, points, 2 * limit if scored else limit, **search).join(
        points.select("point_id", "notice_id"), "point_id"
    )
    if not scored:
        return hits.select("query_id", "notice_id", "score", F.col("rank").alias("place"))
    # Counted, scored and ranked; written once, the search runs once.
    found = staged(hits.select("query_id", "notice_id", "score").join(requests.select("query_id", "firm_id"), "query_id"), "search-hits")
    # Requests of one firm share their scores.
    scores = score_pairs(found.select("firm_id", "notice_id").distinct(), **_narrowed(tables, found))
    return rank_scored(found.join(scores, ["firm_id", "notice_id"]), limit, owner="query_id")


def match_breakdown(
    pairs: DataFrame, tables: dict[str, DataFrame]
) -> DataFrame:
    """Why a pair scored as it did: component scores, counts and the list of issues."""
    scored = score_pairs(pairs, **tables)
    vectors = tables["notice_vectors"].select("notice_id", F.size("embedding").alias("embedding_dimensions"))
    caps = tables["capabilities"].groupBy("firm_id").agg(F.count(F.lit(1)).alias("capabilities_count"))
    wins = tables["past_wins"].groupBy("firm_id").agg(F.count(F.lit(1)).alias("past_wins_count"))
    flat = zero_similarities(pairs, tables["notice_vectors"], tables["capabilities"])
    base = (
        pairs.select("firm_id", "notice_id")
        .join(scored, ["firm_id", "notice_id"], "left")
        .join(vectors, "notice_id", "left")
        .join(caps, "firm_id", "left")
        .join(wins, "firm_id", "left")
        .join(flat, ["firm_id", "notice_id"], "left")
    )
    passed = F.col("total_score").isNotNull()
    issues = F.array(
        F.when(~passed, "filtered out"),
        F.when(F.col("capabilities_count").isNull(), "no capabilities"),
        F.when(passed & (F.col("capability_score") < 0.3), "low capability score"),
        F.when(F.coalesce(F.col("embedding_dimensions"), F.lit(0)) <= 0, "no vector"),
        F.when(F.col("zero_capabilities") > 0, "zero similarity"),
    )
    return base.select(
        "firm_id", "notice_id", "capability_score", "past_win_score", "preference_score",
        F.coalesce("total_score", F.lit(0.0)).alias("total_score"),
        F.coalesce("capabilities_count", F.lit(0)).alias("capabilities_count"),
        F.coalesce("past_wins_count", F.lit(0)).alias("past_wins_count"),
        F.greatest(F.coalesce("embedding_dimensions", F.lit(0)), F.lit(0)).alias("embedding_dimensions"),
        F.coalesce("zero_capabilities", F.lit(0)).alias("zero_capabilities"),
        F.filter(issues, lambda i: i.isNotNull()).alias("issues"),
        F.when(passed, "scored").otherwise("filtered out").alias("status"),
    )


def zero_similarities(pairs: DataFrame, notice_vectors: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Number of a pair's capabilities whose similarity is 0 at four decimals."""
    left, right, sizes = _vector_sides(pairs, notice_vectors, capabilities)

    def count(a: pa.Table, b: pa.Table) -> dict:
        rows, _, cos = tiles.cosines(a, b)
        n = np.zeros(a.num_rows, dtype=np.int64)
        n[rows] = (np.round(cos, 4) == 0).sum(axis=1)
        return {"firm_id": a.column("firm_id"), "notice_id": a.column("notice_id"), "n": n}

    counted = tiles.tile_join(
        left, right, ["firm_id"], ["notice_id"], ["capability_id"], count, "firm_id string, notice_id string, n long", sizes=sizes,
    )
    return counted.groupBy("firm_id", "notice_id").agg(F.sum("n").alias("zero_capabilities"))
