"""Where pairs of firms and notices meet vectors."""

from noticelake.operators import scoring, tiles


def test_pairs_know_their_tiles_before_they_get_a_vector(spark, monkeypatch):
    pairs = spark.createDataFrame([("f", "n1"), ("f", "n2"), ("f", "n3"), ("g", "n1")], "firm_id string, notice_id string")
    noted = spark.createDataFrame([("n1", [1.0, 0.0]), ("n2", [0.6, 0.8]), ("n3", None)], "notice_id string, embedding array<float>")
    held = spark.createDataFrame(
        [("f", 1, [1.0, 0.0]), ("f", 2, [0.0, 1.0]), ("f", 3, [0.6, 0.8]), ("f", 4, [-1.0, 0.0]), ("f", 5, None)],
        "firm_id string, capability_id long, embedding array<float>",
    )
    sides, join = [], tiles.tile_join
    monkeypatch.setattr(tiles, "tile_join", lambda left, *a, **k: sides.append("_lb" in left.columns) or join(left, *a, **k))
    scores = {(r.firm_id, r.notice_id): round(r.capability_score, 6) for r in scoring.capability_score(pairs, noted, held).collect()}
    assert scores == {("f", "n1"): round(1.6 / 3, 6), ("f", "n2"): 0.8, ("f", "n3"): 0.0, ("g", "n1"): 0.0}
    top = sorted((r.notice_id, r.rank, r.capability_id) for r in scoring.capability_top(pairs, noted, held).collect())
    assert top == [("n1", 1, 1), ("n1", 2, 3), ("n1", 3, 2), ("n2", 1, 3), ("n2", 2, 2), ("n2", 3, 1)]
    zero = {(r.firm_id, r.notice_id): r.zero_capabilities for r in scoring.zero_similarities(pairs, noted, held).collect()}
    assert zero == {("f", "n1"): 1, ("f", "n2"): 0, ("g", "n1"): 0} and sides == [True] * 3
