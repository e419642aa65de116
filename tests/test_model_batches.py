"""What a model is handed."""

from noticelake.operators import vectors


def test_a_model_gets_few_texts_at_once(spark):
    rows = spark.range(0, 1800, 1, 1).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('t', id) END AS text")
    made = vectors.embed_model(rows, "id", "text", lambda: lambda texts: [[float(len(texts)), float(t[1:])] for t in texts]).collect()
    assert len(made) == 1800 and {r.id for r in made if r.embedding is None} == set(range(0, 1800, 7))
    assert all(r.embedding[1] == r.id and r.embedding[0] <= 500 for r in made if r.embedding)
