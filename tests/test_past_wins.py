"""Points for past wins against a plain restatement, dealt out in blocks, without a Python step."""

import itertools
import math
import random

import pytest

from noticelake.operators import scoring


def wanted(pairs, notices, wins):
    out = {}
    for firm, notice in pairs:
        for _, buyer, value in (n for n in notices if n[0] == notice):
            own = [w for w in wins if w[0] == firm]
            usable = value is not None and math.isfinite(value) and value != 0
            worth = [w[3] for w in own if w[3] is not None and math.isfinite(w[3]) and w[3] != 0]
            alike = [w for w in worth if usable and min(value, w) / max(value, w) > 0.5]
            names = [w[2].lower() for w in own if w[2]] if buyer else []
            points = sum(0.6 if w == buyer.lower() else 0.4 if w in buyer.lower() or buyer.lower() in w else 0 for w in names)
            out[firm, notice] = out.get((firm, notice), 0) + points + 0.3 * len(alike)
    return {k: min(v, 1.0) for k, v in out.items()}


@pytest.mark.parametrize("block", [8192, 2])
def test_points_need_no_python_and_equal_a_restatement(spark, block):
    rng = random.Random(5)
    values = [None, 0.0, math.nan, math.inf, -math.inf, -40.0, -90.0, 3.0, 10.0, 19.9, 20.0, 41.0, 1e6]
    notices = [(f"n{i}", rng.choice([None, "", "Leeds", "leeds city", "Hull"]), v) for i, v in enumerate(values)] + [("n8", "Hull", 10.0)]
    wins = [(rng.choice("abc"), f"w{i}", rng.choice([None, "LEEDS", "York", "hull"]), rng.choice(values)) for i in range(9)]
    pairs = [p for p in itertools.product(["a", "b", "c", "none"], dict.fromkeys(n[0] for n in notices))] + [("a", "n9"), (None, "n9"), ("a", None)]
    got = scoring.past_win_score(
        spark.createDataFrame(pairs, "firm_id string, notice_id string"),
        spark.createDataFrame(notices, "notice_id string, buyer_name string, value double"),
        spark.createDataFrame(wins, "firm_id string, win_id string, buyer_name string, contract_value double"), block=block,
    )
    plan = got._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
    rows = got.collect()
    found = {(r.firm_id, r.notice_id): r.past_win_score for r in rows}
    assert len(rows) == len(found) and found == pytest.approx(wanted([p for p in pairs if p[0]], notices, wins))
