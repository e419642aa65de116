import random

from pyspark.sql import functions as F

from noticelake.operators import mentions, scoring

PREFERENCES = "firm_id string, min_contract_value double, max_contract_value double, preferred_regions array<string>, excluded_categories array<string>, keywords array<string>"
NOTICES = "notice_id string, title string, description string, buyer_name string, value double, region string"


def test_words_are_found_like_a_plain_search(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abßé Ü-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "BRIDGE works", "bri", "x" * 50 + "dge"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["bridge", "Works", "bri", "ge w", None]
    monkeypatch.setattr(mentions, "SLICE", 64)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(2)
    known = spark.createDataFrame([(w,) for w in words], "word string")
    codes = {r.word: r.code for r in known.where("word IS NOT NULL").select("word", mentions.word_code(F.col("word")).alias("code")).collect()}
    lower = {r.word: r.l for r in known.select("word", F.lower("word").alias("l")).collect()}
    low = {r.k: r.l for r in rows.select("k", F.lower("text").alias("l")).collect()}
    got = {r.k: set(r.mentioned) for r in mentions.mentioned(rows, "text", known).collect()}
    for k in range(len(texts)):
        assert got[k] == {codes[w] for w in words if w is not None and lower[w] in low[k]}, texts[k]


def test_texts_are_not_shuffled_and_both_ways_agree(spark, monkeypatch):
    notices = spark.createDataFrame([
        ("n1", "Road works", "a bridge", "Leeds", 10.0, "North"), ("n2", "Audit", None, "Hull", 5.0, None), ("n3", None, "ROAD", None, None, "South"),
    ], NOTICES)
    preferences = spark.createDataFrame([
        ("a", None, None, ["North"], ["audit"], ["Road", None, "road", "bridge"]), ("b", 6.0, None, None, None, ["zebra"]), ("c", None, 7.0, [], [None, "BRIDGE"], None),
    ], PREFERENCES)
    pairs = spark.createDataFrame([(f, n) for f in "abcd" for n in ("n1", "n2", "n3")], "firm_id string, notice_id string")
    listed = lambda df: sorted((r.firm_id, r.notice_id, r.preference_score, r.rejected, tuple(r.preference_reasons)) for r in df.collect())
    made = scoring.with_preferences(pairs, notices, preferences)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(lines) if "Join" in line and "notice_id" in line)
    assert not any("search_text" in line for line in lines[: join + 1]), "a text goes through the join"
    found = listed(made)
    monkeypatch.setattr(mentions, "WORDS", 2)
    assert listed(scoring.with_preferences(pairs, notices, preferences)) == found
    assert [r for r in found if r[3]] and any("Matches keywords: Road, road, bridge" in r[4] for r in found)
