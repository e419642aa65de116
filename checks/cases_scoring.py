"""Queries over match scoring, recommendations, search and the notification feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cases_vectors import NOTICES, cos, topk_sql
from checks.registry import case
from checks.views import AS_OF_SQL, Views, as_of, with_views
from noticelake.functions import display
from noticelake.operators import feeds, recommendations as rec, scoring
from noticelake.session import staged

SCORE_VIEWS = "notices notice_vectors firms capabilities past_wins preferences pairs points requests users saved"


def scored_sql(pairs: str = "SELECT * FROM pairs") -> str:
    """Scores of the pairs a query gives, as CTEs ending in ``scored``."""
    return f"""asked AS (SELECT DISTINCT firm_id, notice_id FROM ({pairs}) JOIN firms USING (firm_id)),
  base AS (
    SELECT a.firm_id, a.notice_id, n.title, n.buyer_name, n.value, n.region, lower(n.title || ' ' || n.description) AS txt,
           p.firm_id IS NOT NULL AS has_prefs, min_contract_value AS lo, max_contract_value AS hi, preferred_regions, excluded_categories, keywords
    FROM asked a JOIN notices n USING (notice_id) LEFT JOIN preferences p ON p.firm_id = a.firm_id),
  judged AS (
    SELECT *, list_filter(keywords, lambda w: contains(txt, lower(w))) AS hits,
           has_prefs AND ((value <> 0 AND lo <> 0 AND value < lo) OR coalesce(value <> 0 AND hi <> 0 AND value > hi, false)
                          OR len(list_filter(excluded_categories, lambda w: contains(txt, lower(w)))) > 0) AS rejected FROM base),
  pref AS (
    SELECT *, CASE WHEN NOT has_prefs THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN len(preferred_regions) = 0 THEN 1.0::DOUBLE
                WHEN list_contains(preferred_regions, region) THEN 1.2::DOUBLE ELSE 0.6::DOUBLE END + 0.15::DOUBLE * len(hits)) END AS preference_score FROM judged),
  passed AS (SELECT * FROM pref WHERE NOT rejected),
  sims AS (
    SELECT x.firm_id, x.notice_id, c.capability_id, {cos('v.embedding', 'c.embedding')} AS sim
    FROM passed x JOIN notice_vectors v USING (notice_id) JOIN capabilities c ON c.firm_id = x.firm_id WHERE c.embedding IS NOT NULL),
  cap AS (SELECT firm_id, notice_id, avg(sim) AS capability_score FROM (
    SELECT *, row_number() OVER (PARTITION BY firm_id, notice_id ORDER BY sim DESC) AS r FROM sims) WHERE r <= 3 GROUP BY 1, 2),
  wins AS (
    SELECT x.firm_id, x.notice_id, w.win_id, w.buyer_name AS win_buyer, w.contract_value AS win_value,
           CASE WHEN lower(w.buyer_name) = lower(x.buyer_name) THEN 1
                WHEN contains(lower(x.buyer_name), lower(w.buyer_name)) OR contains(lower(w.buyer_name), lower(x.buyer_name)) THEN 2 END AS kind,
           least(x.value, w.contract_value) / greatest(x.value, w.contract_value) AS ratio
    FROM passed x JOIN past_wins w USING (firm_id)),
  won AS (SELECT firm_id, notice_id, least(1.0::DOUBLE, sum(CASE kind WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN ratio > 0.5 THEN 0.3::DOUBLE ELSE 0 END)) AS past_win_score
    FROM wins GROUP BY 1, 2),
  scored AS (
    SELECT firm_id, notice_id, title, buyer_name, value, region, hits, lo, hi, has_prefs, preferred_regions, preference_score,
           coalesce(capability_score, 0) AS capability_score, coalesce(past_win_score, 0) AS past_win_score,
           0.4::DOUBLE * coalesce(capability_score, 0) + 0.3::DOUBLE * coalesce(past_win_score, 0) + 0.3::DOUBLE * preference_score AS total_score
    FROM passed LEFT JOIN cap USING (firm_id, notice_id) LEFT JOIN won USING (firm_id, notice_id))"""


REASONS = """reasons AS (
    SELECT firm_id, notice_id, 1 AS part, '' AS win_id, 0 AS kind, CASE WHEN capability_score > 0.6 THEN 'Strong' WHEN capability_score > 0.4 THEN 'Good' ELSE 'Moderate' END
           || ' capability match (' || format('{:.0f}%', capability_score * 100) || ')' AS reason FROM scored WHERE capability_score > 0.25
    UNION ALL
    SELECT firm_id, notice_id, 2, win_id, kind, CASE kind WHEN 1 THEN 'Previously won contract with ' || win_buyer ELSE 'Previously worked with similar buyer (' || win_buyer || ')' END
    FROM wins WHERE kind IS NOT NULL
    UNION ALL
    SELECT firm_id, notice_id, 2, win_id, 3, 'Similar contract value to past win (£' || format('{:,.0f}', win_value) || ')' FROM wins WHERE ratio > 0.8
    UNION ALL
    SELECT firm_id, notice_id, 3, '', 0, 'Contract value (£' || format('{:,.0f}', value) || ') matches preferences' FROM scored WHERE has_prefs AND value <> 0 AND (coalesce(lo, 0) <> 0 OR coalesce(hi, 0) <> 0)
    UNION ALL
    SELECT firm_id, notice_id, 3, '', 1, 'Located in preferred region (' || region || ')' FROM scored WHERE has_prefs AND list_contains(preferred_regions, region)
    UNION ALL
    SELECT firm_id, notice_id, 3, '', 2, 'Matches keywords: ' || array_to_string(hits[1:3], ', ') FROM scored WHERE has_prefs AND len(hits) > 0)"""


def query(body: str, views: str = SCORE_VIEWS) -> str:
    return with_views(views, "WITH " + body.strip())


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


SCORES = ("capability_score", "past_win_score", "preference_score", "total_score")
SCORES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


# ---- components -------------------------------------------------------------------------------------


@case("avg_top3", query(f"""{scored_sql()} SELECT firm_id, notice_id, r::INT AS rank, round(sim, 6) AS similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY firm_id, notice_id ORDER BY round(sim, 9) DESC, capability_id) AS r FROM (
      SELECT x.firm_id, x.notice_id, c.capability_id, {cos('v.embedding', 'c.embedding')} AS sim
      FROM pairs x JOIN notice_vectors v USING (notice_id) JOIN capabilities c ON c.firm_id = x.firm_id WHERE c.embedding IS NOT NULL)) WHERE r <= 3"""))
def avg_top3(v: Views):
    top = scoring.capability_top(v.pairs, v.notice_vectors, v.capabilities)
    return top.select("firm_id", "notice_id", "rank", F.round("similarity", 6).alias("similarity"))


@case("capability_score", query(f"""{scored_sql()} SELECT firm_id, notice_id, round(avg(sim), 6) AS capability_score,
      CASE WHEN avg(sim) > 0.6 THEN 'Strong' WHEN avg(sim) > 0.4 THEN 'Good' WHEN avg(sim) > 0.25 THEN 'Moderate' END || ' capability match (' || format('{{:.0f}}%', avg(sim) * 100) || ')' AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY firm_id, notice_id ORDER BY sim DESC) AS r FROM (
      SELECT x.firm_id, x.notice_id, {cos('v.embedding', 'c.embedding')} AS sim
      FROM pairs x JOIN notice_vectors v USING (notice_id) JOIN capabilities c ON c.firm_id = x.firm_id WHERE c.embedding IS NOT NULL)) WHERE r <= 3 GROUP BY 1, 2"""))
def capability_score(v: Views):
    s = scoring.capability_score(v.pairs, v.notice_vectors, v.capabilities)
    return r6(s.withColumn("reason", scoring.capability_reason()), "capability_score")


WON_SQL = """SELECT x.firm_id, x.notice_id, coalesce(least(1.0::DOUBLE, sum(
        CASE WHEN lower(w.buyer_name) = lower(n.buyer_name) THEN 0.6::DOUBLE
             WHEN contains(lower(n.buyer_name), lower(w.buyer_name)) OR contains(lower(w.buyer_name), lower(n.buyer_name)) THEN 0.4::DOUBLE ELSE 0 END
        + CASE WHEN least(n.value, w.contract_value) / greatest(n.value, w.contract_value) > 0.5 THEN 0.3::DOUBLE ELSE 0 END)), 0) AS past_win_score
    FROM pairs x JOIN notices n USING (notice_id) LEFT JOIN past_wins w ON w.firm_id = x.firm_id GROUP BY 1, 2"""


@case("past_win_score", with_views(SCORE_VIEWS, f"SELECT firm_id, notice_id, round(past_win_score, 6) AS past_win_score FROM ({WON_SQL})"))
def past_win_score(v: Views):
    return r6(scoring.past_win_score(v.pairs, v.notices, v.past_wins), "past_win_score")


@case("capped_sum", with_views(SCORE_VIEWS, f"SELECT firm_id, count(*) AS pairs, count(*) FILTER (past_win_score >= 1.0) AS capped FROM ({WON_SQL}) GROUP BY 1"))
def capped_sum(v: Views):
    s = scoring.past_win_score(v.pairs, v.notices, v.past_wins)
    return s.groupBy("firm_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("past_win_score") >= 1.0).alias("capped"))


@case("preference_hard_filter", query(f"{scored_sql()} SELECT firm_id, notice_id, rejected FROM pref"))
def preference_hard_filter(v: Views):
    return scoring.with_preferences(v.pairs, v.notices, v.preferences).select("firm_id", "notice_id", "rejected")


@case("preference_score", query(f"""{scored_sql()}
    SELECT firm_id, notice_id, round(preference_score, 6) AS preference_score, concat_ws('|',
      CASE WHEN has_prefs AND value <> 0 AND (coalesce(lo, 0) <> 0 OR coalesce(hi, 0) <> 0) THEN 'Contract value (£' || format('{{:,.0f}}', value) || ') matches preferences' END,
      CASE WHEN has_prefs AND list_contains(preferred_regions, region) THEN 'Located in preferred region (' || region || ')' END,
      CASE WHEN has_prefs AND len(hits) > 0 THEN 'Matches keywords: ' || array_to_string(hits[1:3], ', ') END) AS reasons FROM passed"""))
def preference_score(v: Views):
    p = scoring.with_preferences(v.pairs, v.notices, v.preferences).where("NOT rejected")
    return r6(p.select("firm_id", "notice_id", "preference_score", F.array_join("preference_reasons", "|").alias("reasons")), "preference_score")


@case("buyer_similarity", with_views("notices past_wins", """
    SELECT buyer, win_buyer, CASE WHEN buyer = win_buyer THEN 'equal' ELSE 'contains' END AS kind
    FROM (SELECT DISTINCT lower(buyer_name) AS buyer FROM notices) JOIN (SELECT DISTINCT lower(buyer_name) AS win_buyer FROM past_wins)
      ON contains(buyer, win_buyer) OR contains(win_buyer, buyer)"""))
def buyer_similarity(v: Views):
    return scoring.buyer_similarity(v.notices, v.past_wins)


# ---- pairs ------------------------------------------------------------------------------------------


@case("score_notices", query(f"{scored_sql()} SELECT firm_id, notice_id, {SCORES_SQL} FROM scored"))
def score_notices(v: Views):
    return r6(scoring.score_pairs(v.pairs, **v.scoring_tables), *SCORES)


@case("total_score", query(f"{scored_sql()} SELECT firm_id, count(*) AS scored, round(max(total_score), 6) AS best, count(*) FILTER (round(total_score, 9) >= 0.5) AS good FROM scored GROUP BY 1"))
def total_score(v: Views):
    s = scoring.score_pairs(v.pairs, **v.scoring_tables)
    return s.groupBy("firm_id").agg(
        F.count(F.lit(1)).alias("scored"), F.round(F.max("total_score"), 6).alias("best"),
        F.count_if(F.round("total_score", 9) >= 0.5).alias("good"),
    )


@case("ordered_reasons", query(f"{scored_sql()},\n  {REASONS}\n SELECT firm_id, notice_id, string_agg(reason, '|' ORDER BY part, win_id, kind) AS reasons FROM reasons GROUP BY 1, 2"))
def ordered_reasons(v: Views):
    t = v.scoring_tables
    # Scored and explained; written once, texts meet pairs once.
    judged = staged(scoring.with_preferences(v.pairs, t["notices"], t["preferences"]), "judged-pairs")
    s = scoring.with_reasons(scoring.score_pairs(v.pairs, **t, judged=judged), t["notices"], t["past_wins"], t["preferences"], judged)
    return s.where(F.size("match_reasons") > 0).select("firm_id", "notice_id", F.array_join("match_reasons", "|").alias("reasons"))


DIGEST_USERS = f"""asking AS (SELECT u.email, u.firm_id, coalesce(last_email_sent_at, {AS_OF_SQL} - INTERVAL 1 DAY) AS since
    FROM users u JOIN firms USING (firm_id) WHERE is_active AND email_notifications_enabled AND notification_frequency = 'daily')"""
WINDOW_PAIRS = f"""SELECT DISTINCT a.firm_id, n.notice_id FROM asking a JOIN notices n ON n.published_date >= a.since AND n.published_date <= {AS_OF_SQL}"""


@case("firm_notice_pairs", query(f"{DIGEST_USERS} {WINDOW_PAIRS}"))
def firm_notice_pairs(v: Views):
    asking = feeds.user_firm(feeds.digest_users(v.users, as_of()), v.firms)
    return scoring.firm_notice_pairs(asking.groupBy("firm_id").agg(F.min("since").alias("since")), v.notices, as_of())


@case("user_firm", with_views("users firms", "SELECT email, firm_id, company_name FROM users JOIN firms USING (firm_id)"))
def user_firm(v: Views):
    return feeds.user_firm(v.users, v.firms).join(v.firms.select("firm_id", "company_name"), "firm_id").select("email", "firm_id", "company_name")


RECOMMENDED = f"""{topk_sql('SELECT * FROM requests', NOTICES, 20)},
  {scored_sql('SELECT query_id AS firm_id, notice_id FROM hits')},
  ranked AS (SELECT s.*, h.score, row_number() OVER (PARTITION BY s.firm_id ORDER BY round(total_score, 9) DESC, h.score DESC, s.notice_id) AS place
             FROM scored s JOIN hits h ON h.query_id = s.firm_id AND h.notice_id = s.notice_id)"""


@case("recommend_notices", query(f"{RECOMMENDED} SELECT firm_id, notice_id, round(score, 6) AS score, {SCORES_SQL}, place::INT AS place FROM ranked WHERE place <= 10"))
def recommend_notices(v: Views):
    queries = v.requests.select("firm_id", "embedding")
    return r6(scoring.recommend_notices(queries, v.points, 10, v.scoring_tables), "score", *SCORES)


@case("recommendation_queries", with_views("capabilities", """
    SELECT firm_id, string_agg(capability_text, ' ' ORDER BY n) AS query_text FROM (
      SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY capability_id) AS n FROM capabilities) WHERE n <= 3 GROUP BY 1"""))
def recommendation_queries(v: Views):
    return scoring.capability_queries(v.capability_rows)


@case("recommend_with_reasons", query(f"""{RECOMMENDED},
  {REASONS}
  SELECT k.firm_id, k.notice_id, place::INT AS place, coalesce(string_agg(reason, '|' ORDER BY part, win_id, kind), '') AS match_reasons
  FROM ranked k LEFT JOIN reasons USING (firm_id, notice_id) WHERE place <= 10 GROUP BY ALL"""))
def recommend_with_reasons(v: Views):
    t = v.scoring_tables
    best = scoring.recommend_notices(v.requests.select("firm_id", "embedding"), v.points, 10, t)
    s = scoring.with_reasons(best, t["notices"], t["past_wins"], t["preferences"])
    return s.select("firm_id", "notice_id", "place", F.array_join("match_reasons", "|").alias("match_reasons"))


@case("personalised_search", query(f"""{topk_sql('SELECT * FROM requests', NOTICES + " AND region = 'EUROPE'", 10)},
  {scored_sql('SELECT query_id AS firm_id, notice_id FROM hits')}
  SELECT * FROM (SELECT h.query_id, h.notice_id, round(h.score, 6) AS score, round(total_score, 6) AS total_score,
       (row_number() OVER (PARTITION BY h.query_id ORDER BY round(total_score, 9) DESC, h.score DESC, h.notice_id))::INT AS place
     FROM hits h JOIN scored s ON s.firm_id = h.query_id AND s.notice_id = h.notice_id) WHERE place <= 5"""))
def personalised_search(v: Views):
    s = scoring.personalised_search(v.requests, v.points, 5, v.scoring_tables, region="EUROPE")
    return r6(s.select("query_id", "notice_id", "score", "total_score", "place"), "score", "total_score")


@case("unscored_search", query(f"{topk_sql('SELECT * FROM requests', NOTICES, 5)} SELECT query_id, notice_id, round(score, 6) AS score, rank::INT AS place FROM hits"))
def unscored_search(v: Views):
    return r6(scoring.personalised_search(v.requests, v.points, 5, v.scoring_tables, scored=False), "score")


@case("rank_scored", query(f"""{RECOMMENDED} SELECT firm_id, notice_id, place::INT AS place FROM ranked WHERE place <= 3"""))
def rank_scored(v: Views):
    return scoring.recommend_notices(v.requests.select("firm_id", "embedding"), v.points, 10, v.scoring_tables).where("place <= 3").select(
        "firm_id", "notice_id", "place"
    )


@case("match_breakdown", query(f"""{scored_sql()},
  counts AS (SELECT firm_id, (SELECT count(*) FROM capabilities c WHERE c.firm_id = f.firm_id) AS caps, (SELECT count(*) FROM past_wins w WHERE w.firm_id = f.firm_id) AS wins FROM firms f),
  zero AS (SELECT x.firm_id, x.notice_id, count(*) FILTER (round({cos('v.embedding', 'c.embedding')}, 4) = 0) AS z
           FROM pairs x JOIN notice_vectors v USING (notice_id) JOIN capabilities c ON c.firm_id = x.firm_id WHERE c.embedding IS NOT NULL GROUP BY 1, 2)
  SELECT p.firm_id, p.notice_id, round(capability_score, 6) AS capability_score, round(past_win_score, 6) AS past_win_score,
         round(preference_score, 6) AS preference_score, round(coalesce(total_score, 0), 6) AS total_score, caps AS capabilities_count, wins AS past_wins_count,
         coalesce(len(embedding), 0)::INT AS embedding_dimensions, coalesce(z, 0) AS zero_capabilities,
         concat_ws('|', CASE WHEN total_score IS NULL THEN 'filtered out' END, CASE WHEN caps = 0 THEN 'no capabilities' END,
           CASE WHEN total_score IS NOT NULL AND capability_score < 0.3 THEN 'low capability score' END, CASE WHEN embedding IS NULL THEN 'no vector' END,
           CASE WHEN z > 0 THEN 'zero similarity' END) AS issues,
         CASE WHEN total_score IS NULL THEN 'filtered out' ELSE 'scored' END AS status
  FROM pairs p JOIN counts USING (firm_id) LEFT JOIN scored s USING (firm_id, notice_id) LEFT JOIN notice_vectors USING (notice_id) LEFT JOIN zero USING (firm_id, notice_id)"""))
def match_breakdown(v: Views):
    b = scoring.match_breakdown(v.pairs, v.scoring_tables)
    return r6(b, *SCORES).withColumn("issues", F.array_join("issues", "|"))


# ---- advice -----------------------------------------------------------------------------------------

# Every customer's nation makes a second, thinner set of firms, so that all rules fire.
COUNTS_SQL = """caps AS (SELECT firm_id, capability_text FROM capabilities UNION ALL
           SELECT 'firm-' || lower(c_name), CASE WHEN t % 2 = 0 THEN 'General ' ELSE 'Deep ' END || c_mktsegment FROM customer, range(c_nationkey % 6) r(t)),
  ws AS (SELECT firm_id FROM past_wins UNION ALL SELECT 'firm-' || lower(c_name) FROM customer, range(c_nationkey % 5) r(t)),
  all_firms AS (SELECT firm_id FROM firms UNION ALL SELECT 'firm-' || lower(c_name) FROM customer),
  prefs AS (SELECT firm_id, min_contract_value, max_contract_value, preferred_regions, keywords FROM preferences UNION ALL
            SELECT 'firm-' || lower(c_name), CASE WHEN c_acctbal > 5000 THEN 10 ELSE 0 END, NULL, CASE WHEN c_mktsegment = 'BUILDING' THEN ['ASIA'] ELSE []::VARCHAR[] END,
                   CASE WHEN c_nationkey > 12 THEN ['bolt'] END FROM customer WHERE c_acctbal > 1000),
  counts AS (
  SELECT f.firm_id, (SELECT count(*) FROM caps c WHERE c.firm_id = f.firm_id) AS nc,
         (SELECT count(*) FROM caps c WHERE c.firm_id = f.firm_id AND regexp_matches(lower(capability_text), 'it|software|services|solutions|general|consulting')) AS ng,
         (SELECT count(*) FROM ws w WHERE w.firm_id = f.firm_id) AS nw, p.firm_id IS NOT NULL AS has_prefs,
         min_contract_value AS lo, max_contract_value AS hi, preferred_regions, keywords
  FROM all_firms f LEFT JOIN prefs p USING (firm_id))"""


def steps_sql(steps: tuple[str, ...]) -> str:
    """The steps of an advice as one SQL text."""
    return "'" + "|".join(steps).replace("'", "''") + "'"


ADVICE_SQL = f"""{COUNTS_SQL},
  advice AS (
    SELECT firm_id, 'past_wins' AS category, 1 AS rule_no, nw * 10.0::DOUBLE AS current_score, 30.0::DOUBLE AS potential_score, CASE WHEN nw = 0 THEN 'high' ELSE 'medium' END AS priority,
           CASE WHEN nw = 0 THEN '{rec.NO_WINS}' ELSE 'Add ' || (3 - nw) || ' more past wins to strengthen your track record' END AS action,
           CASE WHEN nw = 0 THEN '+30% to total match score' ELSE '+' || (3 - nw) * 10 || '% potential boost' END AS impact,
           CASE WHEN nw = 0 THEN {steps_sql(rec.FIRST_WIN_STEPS)} ELSE {steps_sql(rec.MORE_WINS_STEPS)} END AS specific_actions FROM counts WHERE nw < 3
    UNION ALL
    SELECT firm_id, 'capabilities', 2, CASE WHEN nc < 3 THEN nc * 10.0::DOUBLE ELSE nc * 8.0::DOUBLE END, 40.0::DOUBLE, CASE WHEN nc < 2 THEN 'high' ELSE 'medium' END,
           CASE WHEN nc < 3 THEN 'Add ' || greatest(3 - nc, 1) || ' domain-specific capabilities' ELSE '{rec.GENERIC}' END,
           CASE WHEN nc < 3 THEN '+' || least(15, (3 - nc) * 5) || '% potential boost' ELSE '+10-15% better relevance scores' END,
           CASE WHEN nc < 3 THEN {steps_sql(rec.MORE_CAPABILITIES_STEPS)} ELSE {steps_sql(rec.GENERIC_STEPS)} END FROM counts WHERE nc < 3 OR (nc < 5 AND ng > nc / 2)
    UNION ALL
    SELECT firm_id, 'preferences', 3, CASE WHEN has_prefs THEN 30.0::DOUBLE - impact ELSE 0 END, 30.0::DOUBLE, 'low',
           CASE WHEN NOT has_prefs THEN '{rec.NO_PREFERENCES}' ELSE 'Complete your search preferences: ' || missing END,
           CASE WHEN NOT has_prefs THEN '+30% better targeted results' ELSE '+' || impact || '% optimization' END,
           CASE WHEN NOT has_prefs THEN {steps_sql(rec.NO_PREFERENCES_STEPS)} ELSE 'Add ' || replace(missing, ', ', '|Add ') END
    FROM (SELECT *, concat_ws(', ', CASE WHEN coalesce(lo, 0) = 0 AND coalesce(hi, 0) = 0 THEN 'contract value range' END, CASE WHEN coalesce(len(preferred_regions), 0) = 0 THEN 'preferred regions' END,
                   CASE WHEN coalesce(len(keywords), 0) = 0 THEN 'target keywords' END) AS missing,
             CASE WHEN coalesce(lo, 0) = 0 AND coalesce(hi, 0) = 0 THEN 8 ELSE 0 END + CASE WHEN coalesce(len(preferred_regions), 0) = 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(len(keywords), 0) = 0 THEN 7 ELSE 0 END AS impact
          FROM counts) WHERE NOT has_prefs OR missing <> '')"""


def counts(v: Views):
    c = v.table("customer").withColumn("firm_id", F.concat(F.lit("firm-"), F.lower("c_name")))
    many = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    caps = c.select("firm_id", "c_mktsegment", many(F.col("c_nationkey") % 6).alias("t")).select(
        "firm_id", F.concat(F.when(F.col("t") % 2 == 0, "General ").otherwise("Deep "), "c_mktsegment").alias("capability_text")
    )
    wins = c.select("firm_id", many(F.col("c_nationkey") % 5).alias("t")).select("firm_id")
    none = F.array().cast("array<string>")
    prefs = c.where("c_acctbal > 1000").select(
        "firm_id", F.when(F.col("c_acctbal") > 5000, 10.0).otherwise(0.0).alias("min_contract_value"), F.lit(None).cast("double").alias("max_contract_value"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("ASIA"))).otherwise(none).alias("preferred_regions"),
        F.when(F.col("c_nationkey") > 12, F.array(F.lit("bolt"))).alias("keywords"),
    )
    firms = v.firms.select("firm_id").unionByName(c.select("firm_id"))
    return rec.profile_counts(
        firms, v.capability_rows.select("firm_id", "capability_text").unionByName(caps), v.past_wins.select("firm_id").unionByName(wins),
        v.preferences.drop("excluded_categories").unionByName(prefs),
    )


def advice_sql(body: str) -> str:
    return query(f"{ADVICE_SQL} {body}", "firms capabilities past_wins preferences")


ADVICE_COLUMNS = "firm_id, category, rule_no, current_score, potential_score, priority, action, impact, specific_actions"


def shown(advice):
    return advice.withColumn("specific_actions", F.array_join("specific_actions", "|"))


@case("profile_counts", query(f"{COUNTS_SQL} SELECT firm_id, nc AS capabilities_count, nw AS past_wins_count, has_prefs AS has_preferences FROM counts", "firms capabilities past_wins preferences"))
def profile_counts(v: Views):
    return counts(v).select("firm_id", "capabilities_count", "past_wins_count", "has_preferences")


@case("generic_share", query(f"{COUNTS_SQL} SELECT firm_id, ng AS generic_count, ng > nc / 2 AS mostly_generic FROM counts", "firms capabilities past_wins preferences"))
def generic_share(v: Views):
    return counts(v).select("firm_id", "generic_count", (F.col("generic_count") > F.col("capabilities_count") / 2).alias("mostly_generic"))


@case("recommend_past_wins", advice_sql(f"SELECT {ADVICE_COLUMNS} FROM advice WHERE rule_no = 1"))
def recommend_past_wins(v: Views):
    return shown(rec.recommend_past_wins(counts(v)))


@case("recommend_capabilities", advice_sql(f"SELECT {ADVICE_COLUMNS} FROM advice WHERE rule_no = 2"))
def recommend_capabilities(v: Views):
    return shown(rec.recommend_capabilities(counts(v)))


@case("recommend_preferences", advice_sql(f"SELECT {ADVICE_COLUMNS} FROM advice WHERE rule_no = 3"))
def recommend_preferences(v: Views):
    return shown(rec.recommend_preferences(counts(v)))


@case("recommendations", advice_sql(f"SELECT {ADVICE_COLUMNS} FROM advice"))
def recommendations(v: Views):
    return shown(rec.recommendations(counts(v))).drop("sort_key")


@case("priority_order", advice_sql("""SELECT firm_id, category, priority, (row_number() OVER (PARTITION BY firm_id
    ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule_no))::INT AS position FROM advice"""))
def priority_order(v: Views):
    from pyspark.sql import Window

    w = Window.partitionBy("firm_id").orderBy("sort_key")
    return rec.recommendations(counts(v)).select("firm_id", "category", "priority", F.row_number().over(w).alias("position"))


# ---- feeds ------------------------------------------------------------------------------------------

MATCHES = f"""{DIGEST_USERS},
  {scored_sql(WINDOW_PAIRS)},
  matches AS (SELECT a.email, s.*, n.closing_date FROM asking a JOIN scored s USING (firm_id) JOIN notices n USING (notice_id)
              WHERE n.published_date >= a.since AND round(s.total_score, 9) >= 0.5),
  best AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY round(total_score, 9) DESC, notice_id) AS place, count(*) OVER (PARTITION BY email) AS total_new FROM matches)"""


@case("digest_totals", query(f"{MATCHES} SELECT email, notice_id, place::INT AS place, total_new, round(total_score, 6) AS total_score FROM best WHERE place <= 5"))
def digest_totals(v: Views):
    m = feeds.digest_matches(v.users, as_of(), v.scoring_tables, feeds.DIGEST_SIZE)
    return r6(feeds.digest_totals(m).select("email", "notice_id", "place", "total_new", "total_score"), "total_score")


@case("daily_digest", query(f"""{MATCHES},
  {REASONS},
  lead AS (SELECT firm_id, notice_id, arg_min(reason, (part, win_id, kind)) AS reason FROM reasons GROUP BY 1, 2)
  SELECT email, b.firm_id, place::INT AS place, total_new, b.notice_id, title, buyer_name, '£' || format('{{:,.0f}}', value) AS value,
         strftime(closing_date, '%d %B %Y') AS deadline, trunc(round(total_score, 9) * 100)::INT AS match_score, coalesce(reason, 'Matches your profile') AS match_reason,
         '🎯 ' || total_new || ' new contracts match your profile' AS subject
  FROM best b LEFT JOIN lead l ON l.firm_id = b.firm_id AND l.notice_id = b.notice_id WHERE place <= 5"""))
def daily_digest(v: Views):
    return feeds.daily_digest(v.users, as_of(), v.scoring_tables)


@case("reminder_join", with_views("saved users", """
    SELECT user_email, notice_id, full_name, status FROM saved JOIN users ON email = user_email
    WHERE status IN ('interested', 'bidding') AND deadline IS NOT NULL AND is_active AND email_notifications_enabled"""))
def reminder_join(v: Views):
    return feeds.reminder_join(v.saved, v.users).select("user_email", "notice_id", "full_name", "status")


REMIND = f"""due AS (SELECT *, datediff('day', {AS_OF_SQL}::DATE, deadline::DATE) AS days_until FROM saved JOIN users ON email = user_email
    WHERE status IN ('interested', 'bidding') AND is_active AND email_notifications_enabled)"""


@case("deadline_reminders", query(f"""{REMIND}
    SELECT user_email, full_name, notice_id, contract_title AS title, buyer_name, '£' || format('{{:,.0f}}', contract_value) AS value,
           strftime(deadline, '%d %B %Y') AS deadline, upper(status[1]) || status[2:] AS status, days_until::INT AS days_until,
           CASE WHEN days_until = 1 THEN '🚨' ELSE '⏰' END || ' Deadline in ' || days_until || ' day' || CASE WHEN days_until > 1 THEN 's' ELSE '' END || ': ' || left(contract_title, 50) || '...' AS subject,
           CASE days_until WHEN 1 THEN 'urgent' WHEN 3 THEN 'soon' ELSE 'notice' END AS urgency,
           CASE days_until WHEN 1 THEN 'URGENT: Deadline Tomorrow!' WHEN 3 THEN 'Deadline in 3 Days' ELSE 'Deadline in ' || days_until || ' Days' END AS banner
    FROM due WHERE days_until IN (7, 3, 1)"""))
def deadline_reminders(v: Views):
    return feeds.deadline_reminders(v.saved, v.users, as_of())


@case("mark_sent", query(f"""{REMIND}
    SELECT email, strftime(CASE WHEN email IN (SELECT user_email FROM due WHERE days_until IN (7, 3, 1)) THEN {AS_OF_SQL} ELSE last_email_sent_at END, '%Y-%m-%d %H:%M') AS last_sent FROM users"""))
def mark_sent(v: Views):
    sent = feeds.deadline_reminders(v.saved, v.users, as_of()).select(F.col("user_email").alias("email"))
    return feeds.mark_sent(v.users, sent, as_of()).select("email", F.date_format("last_email_sent_at", "yyyy-MM-dd HH:mm").alias("last_sent"))


@case("format_value", "SELECT o_orderkey, '£' || format('{:,.0f}', o_totalprice) AS value, o_orderpriority AS text FROM orders")
def format_value(v: Views):
    return v.table("orders").select("o_orderkey", display.format_value("o_totalprice").alias("value"), display.format_value("o_orderpriority").alias("text"))


@case("format_deadline", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Not specified' ELSE strftime(o_orderdate, '%d %B %Y') END AS deadline FROM orders")
def format_deadline(v: Views):
    when = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return v.table("orders").select("o_orderkey", display.format_deadline(when).alias("deadline"))


@case("score_percent", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(trunc(l_discount * 100), 0)::INT AS percent FROM lineitem")
def score_percent(v: Views):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", display.percent("l_discount").alias("percent"))


@case("digest_subject", """
    SELECT o_orderkey, '🎯 ' || o_custkey || ' new contracts match your profile' AS digest,
           CASE WHEN d = 1 THEN '🚨' ELSE '⏰' END || ' Deadline in ' || d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END || ': ' || left(t, 50) || '...' AS reminder
    FROM (SELECT *, left(o_orderpriority, 1)::INT AS d, repeat(o_orderpriority || ' ', 6) AS t FROM orders)""")
def digest_subject(v: Views):
    o = v.table("orders").withColumns({"d": F.substring("o_orderpriority", 1, 1).cast("int"), "t": F.repeat(F.concat("o_orderpriority", F.lit(" ")), 6)})
    return o.select("o_orderkey", display.digest_subject("o_custkey").alias("digest"), display.reminder_subject("d", "t").alias("reminder"))


@case("urgency_band", """
    SELECT o_orderkey, CASE d WHEN 1 THEN 'urgent' WHEN 3 THEN 'soon' ELSE 'notice' END AS band,
           CASE d WHEN 1 THEN 'URGENT: Deadline Tomorrow!' WHEN 3 THEN 'Deadline in 3 Days' ELSE 'Deadline in ' || d || ' Days' END AS banner
    FROM (SELECT *, left(o_orderpriority, 1)::INT AS d FROM orders)""")
def urgency_band(v: Views):
    o = v.table("orders").withColumn("d", F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select("o_orderkey", display.urgency_band("d").alias("band"), display.urgency_text("d").alias("banner"))
