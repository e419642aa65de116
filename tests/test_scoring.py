"""Pair scores and reasons: hand-worked rows, and properties that hold whatever the tiles."""

import random

import pytest

from noticelake.operators import scoring

NOTICES = [
    ("exact", "Road works", "bridge", "Leeds", 100.0, "North"),
    ("inside", "Audit works", None, "Leeds City", 100.0, "South"),
    ("other", "Road and bridge", None, "Hull", None, "South"),
]
# firm, notice: capability, past win, preference and total score, and the reasons.
WANTED = {
    ("a", "exact"): ((1.0, 0.9, 1.0, 0.97), [
        "Strong capability match (100%)", "Previously won contract with Leeds", "Similar contract value to past win (£100)",
        "Contract value (£100) matches preferences", "Located in preferred region (North)", "Matches keywords: road",
    ]),
    ("a", "other"): ((0.0, 0.0, 0.75, 0.225), ["Matches keywords: road"]),
    ("b", "exact"): ((0.0, 0.9, 1.0, 0.57), ["Previously won contract with Leeds"]),
    ("b", "inside"): ((0.0, 0.7, 1.0, 0.51), ["Previously worked with similar buyer (Leeds)"]),
    ("b", "other"): ((0.0, 0.0, 1.0, 0.3), []),
}


@pytest.mark.parametrize("block", [8192, 1])
def test_hand_worked_scores(spark, block):
    """Firm a: one capability like the first notice, a minimum of 100, region North, no audits. Firm b: one win of 60."""
    firms = spark.createDataFrame([("a",), ("b",)], "firm_id string")
    t = {
        "notices": spark.createDataFrame(NOTICES, "notice_id string, title string, description string, buyer_name string, value double, region string"),
        "notice_vectors": spark.createDataFrame([("exact", [1.0, 0.0]), ("other", [0.0, 1.0])], "notice_id string, embedding array<float>"),
        "firms": firms,
        "capabilities": spark.createDataFrame([("a", 1, [2.0, 0.0]), ("b", 2, None)], "firm_id string, capability_id long, embedding array<float>"),
        "past_wins": spark.createDataFrame([("a", "w1", "Leeds", 100.0), ("b", "w2", "Leeds", 60.0)], "firm_id string, win_id string, buyer_name string, contract_value double"),
        "preferences": spark.createDataFrame(
            [("a", 100.0, None, ["North"], ["audit"], ["road"])],
            "firm_id string, min_contract_value double, max_contract_value double, preferred_regions array<string>, excluded_categories array<string>, keywords array<string>",
        ),
    }
    pairs = firms.crossJoin(t["notices"].select("notice_id"))
    scored = scoring.score_pairs(pairs, **t, block=block)
    rows = scoring.with_reasons(scored, t["notices"], t["past_wins"], t["preferences"]).collect()
    got = {(r.firm_id, r.notice_id): r for r in rows}
    assert set(got) == set(WANTED)
    for key, (numbers, reasons) in WANTED.items():
        r = got[key]
        assert [r.capability_score, r.past_win_score, r.preference_score, r.total_score] == pytest.approx(numbers), key
        assert r.match_reasons == reasons and r.reasons_page == 0, key


WINS = "firm_id string, win_id string, buyer_name string, contract_value double"
ABOUT = "notice_id string, buyer_name string, value double"


def restated_points(buyer, value, wins):
    """A pair's past win points and the kinds of its reasons, win by win."""
    points, kinds = 0.0, []
    for win_id, other, worth in wins:
        a, b = (buyer or "").lower(), (other or "").lower()
        if a and b and (a == b or a in b or b in a):
            points += 0.6 if a == b else 0.4
            kinds.append((win_id, 1 if a == b else 2))
        if value and worth:
            ratio = min(value, worth) / max(value, worth)
            points += 0.3 if ratio > 0.5 else 0
            kinds += [(win_id, 3)] if ratio > 0.8 else []
    return min(points, 1.0), sorted(kinds)


@pytest.mark.parametrize("seed", range(4))
def test_wins_of_all_signs_and_names(spark, seed):
    """Values of both signs, zero and null, buyers that hold each other, are equal, empty or null."""
    rng = random.Random(seed)
    worths = [None, 0.0, -100.0, -150.0, -1000.0, -99.9, 100.0, 125.0, 124.9, 199.9, 200.0, 201.0, 1e-9, -1e-9]
    names = [None, "", "Leeds", "LEEDS", "Leeds City", "York", "New York", "Y", "or", "Hull"]
    wins = [(f"f{f}", f"w{f}-{k}", rng.choice(names), rng.choice(worths)) for f in range(12) for k in range(rng.randint(0, 5))]
    about = [(f"n{k}", rng.choice(names), v) for k, v in enumerate(worths * 2)]
    pairs = [(f"f{f}", n[0]) for f in range(12) for n in about]
    tables = spark.createDataFrame(pairs, "firm_id string, notice_id string"), spark.createDataFrame(about, ABOUT), spark.createDataFrame(wins, WINS)
    got = {(r.firm_id, r.notice_id): r.past_win_score for r in scoring.past_win_score(*tables).collect()}
    reasons = {}
    for r in scoring.win_reasons(*tables).collect():
        reasons.setdefault((r.firm_id, r.notice_id), []).append((r.win_id, r.kind))
    held = {f: [w[1:] for w in wins if w[0] == f] for f, _ in pairs}
    for firm, notice in pairs:
        _, buyer, value = next(n for n in about if n[0] == notice)
        points, kinds = restated_points(buyer, value, held[firm])
        assert got[firm, notice] == pytest.approx(points), (firm, buyer, value, held[firm])
        assert sorted(reasons.get((firm, notice), [])) == kinds


def test_wins_of_both_signs(spark):
    """Two wins are alike in value; the many others, negative or too large, must not crowd them out."""
    worth = [-3.0, -3.01, -3.02, -3.03, 2.1, 2.2, 3.99, 3.99, 3.99, 3.99]
    wins = spark.createDataFrame([("f", f"w{k}", "x", v) for k, v in enumerate(worth)], WINS)
    about = spark.createDataFrame([("n", "Nobody", 1.15)], ABOUT)
    row = scoring.past_win_score(spark.createDataFrame([("f", "n")], "firm_id string, notice_id string"), about, wins).first()
    assert row.past_win_score == pytest.approx(0.6)


def test_more_wins_never_lower_a_score(spark):
    rng = random.Random(3)
    wins = [("f", f"w{k}", rng.choice(["Leeds", "York", "Leeds City"]), rng.choice([50.0, 120.0, 900.0])) for k in range(8)]
    schema = "firm_id string, win_id string, buyer_name string, contract_value double"
    about = spark.createDataFrame([("n1", "Leeds", 100.0), ("n2", "Hull", 500.0)], "notice_id string, buyer_name string, value double")
    pairs = spark.createDataFrame([("f", "n1"), ("f", "n2")], "firm_id string, notice_id string")
    last = {"n1": 0.0, "n2": 0.0}
    for n in (1, 3, 8):
        now = {r.notice_id: r.past_win_score for r in scoring.past_win_score(pairs, about, spark.createDataFrame(wins[:n], schema)).collect()}
        assert all(last[k] <= now[k] + 1e-12 and now[k] <= 1 for k in now)
        last = now


def test_buyer_similarity_is_all_containment(spark):
    ours = ["Leeds", "Leeds City Council", "York", "aa"]
    theirs = ["leeds", "city", "New York", "a", "zz", ""]
    df = lambda names: spark.createDataFrame([(n,) for n in names], "buyer_name string")
    got = {(r.buyer, r.win_buyer, r.kind) for r in scoring.buyer_similarity(df(ours), df(theirs)).collect()}
    want = {
        (a, b, "equal" if a == b else "contains")
        for a in map(str.lower, ours) for b in map(str.lower, theirs) if b and (a in b or b in a)
    }
    assert got == want


def test_names_meet_by_their_rarest_piece(spark):
    """Random names over few letters, so that many hold each other; common pieces are not what they meet by."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(250)] + ["the " + "xyz"[k % 3] * k for k in range(1, 40)]
    ours, theirs = words[::2], words[1::2]
    df = lambda names: spark.createDataFrame([(n,) for n in names], "buyer_name string")
    got = [(r.buyer, r.win_buyer, r.kind) for r in scoring.buyer_similarity(df(ours), df(theirs)).collect()]
    want = {(a, b, "equal" if a == b else "contains") for a in ours for b in theirs if a in b or b in a}
    assert len(got) == len(set(got)) and set(got) == want


def test_evidence_is_compact(spark):
    """A firm with thousands of wins has few rows of evidence."""
    rng = random.Random(5)
    wins = [("f", f"w{i:05d}", rng.choice(["Leeds", "York", "Leeds City", "Bath"]), round(2 ** rng.uniform(0, 20), 2)) for i in range(3000)]
    held = spark.createDataFrame(wins, "firm_id string, win_id string, buyer_name string, contract_value double")
    assert scoring.firm_evidence(None, held).count() < 20 * 8 + 4 + 1
