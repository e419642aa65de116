"""Profile counts and rule-based advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import contains_any

# Words that mark a capability as generic (matched anywhere in the text).
GENERIC_WORDS = ["it", "software", "services", "solutions", "general", "consulting"]
PRIORITIES = ("high", "medium", "low")

# Texts of the advice.
NO_WINS = "Add 1-2 similar past contract wins to demonstrate relevant experience"
GENERIC = "Make capabilities more specific to improve semantic matching"
NO_PREFERENCES = "Set search preferences to filter and focus results"

# The single steps of each advice.
FIRST_WIN_STEPS = (
    "Add a past win in your main capability area",
    "Include contract value and buyer organization name",
    "Focus on government/public sector contracts",
)
MORE_WINS_STEPS = (
    "Add wins from different government buyers",
    "Include recent contracts (last 2-3 years)",
    "Aim for at least 3 past wins for credibility",
)
MORE_CAPABILITIES_STEPS = (
    "Use specific terminology like 'Fleet Management Systems' instead of 'IT Services'",
    "Add 'Digital Transformation for Government' or 'Cloud Infrastructure Migration'",
    "Match language from contracts you're interested in",
)
GENERIC_STEPS = (
    "Replace 'IT Services' → 'Cybersecurity Auditing & Compliance'",
    "Replace 'Software Development' → 'GOV.UK Service Standard Development'",
    "Use exact phrases from top-scoring contracts",
)
NO_PREFERENCES_STEPS = (
    "Set minimum/maximum contract values",
    "Add preferred regions (e.g., London, South East)",
    "Add keywords for your specialization",
)


def profile_counts(firms: DataFrame, capabilities: DataFrame, past_wins: DataFrame, preferences: DataFrame) -> DataFrame:
    """Capabilities, generic ones, past wins and preferences per firm; firms without any are kept."""
    generic = contains_any(F.lower("capability_text"), GENERIC_WORDS)
    caps = capabilities.groupBy("firm_id").agg(
        F.count(F.lit(1)).alias("capabilities_count"), F.count_if(generic).alias("generic_count")
    )
    wins = past_wins.groupBy("firm_id").agg(F.count(F.lit(1)).alias("past_wins_count"))
    prefs = preferences.select(
        "firm_id", "min_contract_value", "max_contract_value", "preferred_regions", "keywords",
        F.lit(True).alias("has_preferences"),
    )
    joined = firms.select("firm_id").join(caps, "firm_id", "left").join(wins, "firm_id", "left").join(prefs, "firm_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "firm_id", zero("capabilities_count"), zero("generic_count"), zero("past_wins_count"),
        F.coalesce("has_preferences", F.lit(False)).alias("has_preferences"),
        "min_contract_value", "max_contract_value", "preferred_regions", "keywords",
    )


def _listed(steps: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(s) for s in steps])


def _advice(df: DataFrame, category: str, rule_no: int, current, potential, priority, action, impact, steps) -> DataFrame:
    return df.select(
        "firm_id", F.lit(category).alias("category"), F.lit(rule_no).alias("rule_no"),
        current.cast("double").alias("current_score"), F.lit(potential).alias("potential_score"),
        priority.alias("priority"), action.alias("action"), impact.alias("impact"),
        steps.alias("specific_actions"),
    ).where("priority is not null")


def recommend_past_wins(counts: DataFrame) -> DataFrame:
    n = F.col("past_wins_count")
    few = n < 3
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return _advice(
        counts.where(few), "past_wins", 1, n * 10, 30.0,
        F.when(n == 0, "high").otherwise("medium"),
        F.when(n == 0, NO_WINS).otherwise(text("Add ", (3 - n).cast("string"), " more past wins to strengthen your track record")),
        F.when(n == 0, "+30% to total match score").otherwise(text("+", ((3 - n) * 10).cast("string"), "% potential boost")),
        F.when(n == 0, _listed(FIRST_WIN_STEPS)).otherwise(_listed(MORE_WINS_STEPS)),
    )


def recommend_capabilities(counts: DataFrame) -> DataFrame:
    n = F.col("capabilities_count")
    vague = (n < 5) & (F.col("generic_count") > n / 2)
    add = F.greatest(3 - n, F.lit(1)).cast("string")
    boost = F.least(F.lit(15), (3 - n) * 5).cast("string")
    return _advice(
        counts.where((n < 3) | vague), "capabilities", 2, F.when(n < 3, n * 10).otherwise(n * 8), 40.0,
        F.when(n < 2, "high").otherwise("medium"),
        F.when(n < 3, F.concat(F.lit("Add "), add, F.lit(" domain-specific capabilities"))).otherwise(GENERIC),
        F.when(n < 3, F.concat(F.lit("+"), boost, F.lit("% potential boost"))).otherwise("+10-15% better relevance scores"),
        F.when(n < 3, _listed(MORE_CAPABILITIES_STEPS)).otherwise(_listed(GENERIC_STEPS)),
    )


def recommend_preferences(counts: DataFrame) -> DataFrame:
    unset = lambda c: ~F.coalesce(F.col(c) != 0, F.lit(False))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    # What may be missing and what it is worth.
    gaps = (
        (unset("min_contract_value") & unset("max_contract_value"), "contract value range", 8),
        (empty("preferred_regions"), "preferred regions", 10),
        (empty("keywords"), "target keywords", 7),
    )
    missing = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t, _ in gaps]), lambda t: t.isNotNull())
    impact = sum((F.when(c, F.lit(w)).otherwise(0) for c, _, w in gaps), F.lit(0))
    has = F.col("has_preferences")
    return _advice(
        counts.where(~has | (F.size(missing) > 0)), "preferences", 3,
        F.when(has, 30 - impact).otherwise(0), 30.0, F.lit("low"),
        F.when(~has, NO_PREFERENCES).otherwise(
            F.concat(F.lit("Complete your search preferences: "), F.array_join(missing, ", "))
        ),
        F.when(~has, "+30% better targeted results").otherwise(F.concat(F.lit("+"), impact.cast("string"), F.lit("% optimization"))),
        F.when(~has, _listed(NO_PREFERENCES_STEPS)).otherwise(F.transform(missing, lambda m: F.concat(F.lit("Add "), m))),
    )


def priority_rank(priority: str = "priority"):
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col(priority))


def recommendations(counts: DataFrame) -> DataFrame:
    """All advice; ``sort_key`` orders a firm's list (high, medium, low, then rule order)."""
    rules = recommend_past_wins(counts).unionByName(recommend_capabilities(counts)).unionByName(recommend_preferences(counts))
    # Three rules at most per firm, one rank each, so the place is arithmetic and needs no window.
    return rules.withColumn("sort_key", priority_rank() * 10 + F.col("rule_no"))
