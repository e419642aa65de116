"""A search is run once, however often its hits are read, and only found notices are scored."""

import pyarrow as pa
import pytest

from noticelake.operators import scoring

TABLES = {
    "notices": ([("n1", "Road", "works", "Leeds", 100.0, "North"), ("n2", "Bridge", None, "Hull", 50.0, "South"), ("n3", "Audit", None, "Hull", 50.0, "South")],
                "notice_id string, title string, description string, buyer_name string, value double, region string"),
    "notice_vectors": ([("n1", [1.0, 0.0]), ("n2", [0.0, 1.0]), ("n3", [0.6, 0.8])], "notice_id string, embedding array<float>"),
    "firms": ([("a",), ("b",)], "firm_id string"),
    "capabilities": ([("a", 1, [1.0, 0.0])], "firm_id string, capability_id long, embedding array<float>"),
    "past_wins": ([("b", "w", "Hull", 50.0)], "firm_id string, win_id string, buyer_name string, contract_value double"),
    "preferences": ([], "firm_id string, min_contract_value double, max_contract_value double, preferred_regions array<string>, excluded_categories array<string>, keywords array<string>"),
}


@pytest.mark.parametrize("name", ["recommend_notices", "personalised_search"])
def test_hits_are_searched_once(spark, monkeypatch, name):
    tables = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in TABLES.items()}
    searched, scored, score = spark.sparkContext.accumulator(0), [], scoring.score_pairs

    def counted(batches):
        for batch in batches:
            searched.add(batch.num_rows)
            yield batch

    hits = spark.createDataFrame([("a", "p1", 0.9, 1), ("b", "p2", 0.8, 1)], "query_id string, point_id string, score double, rank int").coalesce(1)
    monkeypatch.setattr(scoring, "search_notices", lambda *a, **k: hits.mapInArrow(counted, hits.schema))
    monkeypatch.setattr(scoring, "score_pairs", lambda pairs, **t: scored.append(t) or score(pairs, **t))
    points = spark.createDataFrame([("p1", "n1"), ("p2", "n2"), ("p3", "n3")], "point_id string, notice_id string")
    asked = spark.createDataFrame([("a", "a"), ("b", "b")], "query_id string, firm_id string")
    found = getattr(scoring, name)(asked.select("firm_id") if name == "recommend_notices" else asked, points, 5, tables)
    assert sorted((r.firm_id, r.notice_id, r.place) for r in found.collect()) == [("a", "n1", 1), ("b", "n2", 1)]
    assert searched.value == hits.count()
    assert [sorted(r.notice_id for r in scored[0][t].collect()) for t in ("notices", "notice_vectors")] == [["n1", "n2"]] * 2
