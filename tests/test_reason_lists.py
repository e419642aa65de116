import random

import pytest
from pyspark.sql import functions as F

from noticelake.operators import scoring
from tests.test_mentions import NOTICES, PREFERENCES


@pytest.mark.parametrize("limit,page", [(2048, 10_000), (12, 10_000), (2048, 7)])
def test_lists_made_in_tiles_equal_those_gathered_from_rows(spark, monkeypatch, limit, page):
    rng = random.Random(7)
    buyers = ["Leeds", "LEEDS City", "leeds", "Hull", "", None, "Hullé"]
    value = lambda: rng.choice([None, 0.0, -5.0, round(rng.uniform(80, 130), 2), round(rng.uniform(80, 130), 2)])
    about = [(f"n{k}", rng.choice(["Road works", "Audit"]), None, rng.choice(buyers), value(), rng.choice(["North", None])) for k in range(25)]
    notices = spark.createDataFrame(about + about[:3] + [("n4", "Road", None, "Hull", 100.0, "South")], NOTICES)
    won = [(f"f{f}", f"w{k}", rng.choice(buyers), value()) for f in range(4) for k in range(f * 6)]
    wins = spark.createDataFrame(won + won[:5] + [("f3", "w1", "Leeds", 101.0)], "firm_id string, win_id string, buyer_name string, contract_value double")
    preferences = spark.createDataFrame([(f"f{f}", 1.0, None, ["North"], None, ["road"]) for f in (0, 2, 2, 3)], PREFERENCES)
    pairs = [(f"f{f}", f"n{k}", rng.choice([0.1, 0.3, 0.5, 0.7])) for f in range(6) for k in range(27)]
    scored = spark.createDataFrame(pairs + pairs[50:53] + [(None, "n1", 0.9), ("f1", None, 0.9)], "firm_id string, notice_id string, capability_score double")
    shown = lambda df: sorted(((r.firm_id, r.notice_id, r.capability_score, r.reasons_page, tuple(r.match_reasons)) for r in df.collect()), key=str)
    monkeypatch.setattr(scoring, "PAGE_ROWS", page)
    monkeypatch.setattr("noticelake.operators.scoring.paged_lists", lambda *a, held=scoring.paged_lists: held(*a, size=page))
    want = shown(scoring._listed_from_rows(scored, notices, wins, preferences, None))
    assert max(len(r[4]) for r in want) > 6
    monkeypatch.setattr(scoring, "LISTED_WINS", limit)
    monkeypatch.setattr(scoring, "LISTED_PAIRS", 4)
    gathered = []
    monkeypatch.setattr(scoring, "reason_rows", lambda s, *a, held=scoring.reason_rows: gathered.append(s) or held(s, *a))
    assert shown(scoring.with_reasons(scored, notices, wins, preferences)) == want
    # Reasons are rows for firms of many wins only.
    assert [s.select("firm_id").distinct().count() for s in gathered] == ([] if limit > 100 else [1])
