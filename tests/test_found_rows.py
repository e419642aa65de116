from noticelake.operators import state, vectors


def test_points_are_narrowed_before_they_get_their_texts(spark):
    base = spark.createDataFrame([(f"p{k}", f"n{k}", k % 3) for k in range(50)] + [("p7", "n7b", 1)], "point_id string, notice_id string, doc_id int")
    points = base.join(spark.createDataFrame([(k, f"text {k}") for k in range(3)], "doc_id int, content string"), "doc_id")
    hits = spark.createDataFrame([("q1", "p7", 0.5), ("q2", "p7", 0.4), ("q2", "p9", 0.3)], "query_id string, point_id string, score double")
    met = vectors.with_points(hits, points)
    got = sorted((r.query_id, r.notice_id, r.content) for r in met.collect())
    assert got == [("q1", "n7", "text 1"), ("q1", "n7b", "text 1"), ("q2", "n7", "text 1"), ("q2", "n7b", "text 1"), ("q2", "n9", "text 0")]
    lines = met._jdf.queryExecution().optimizedPlan().toString().splitlines()
    text = next(line.index("Join Inner, (doc_id") for line in lines if "Join Inner, (doc_id" in line)
    assert any("Join LeftSemi" in line and line.index("Join") > text for line in lines)


def test_lookup_leaves_out_texts_that_no_one_reads(spark):
    points = spark.createDataFrame(
        [("p2", "n1", 2.0, "b"), ("p1", "n1", 1.0, "a"), ("p1", "n1", 1.0, "a"), ("p3", "n3", 3.0, "c"), ("p4", None, 4.0, "d")],
        "point_id string, notice_id string, value double, content string",
    )
    asked = spark.createDataFrame([("n1",), ("n1",), ("n2",), (None,)], "notice_id string")
    found = state.notice_lookup(points, asked)
    assert found.columns == points.columns and [tuple(r) for r in found.collect()] == [("p1", "n1", 1.0, "a")]
    plan = found.select("notice_id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "content" in line and "LogicalRDD" not in line]
