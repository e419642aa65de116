"""Exact search against brute force, on both routes and under skew."""

import hashlib

import numpy as np
import pytest

from noticelake.operators import groups, tiles, vectors


def table(spark, ids, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], f"{name} string, embedding array<float>")


def brute(q, p, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    score = np.round(unit(q.astype(np.float32).astype(float)) @ unit(p.astype(np.float32).astype(float)).T, 9)
    ids = np.array([f"p{i:04d}" for i in range(len(p))])
    return {f"q{i:03d}": [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:k]] for i, s in enumerate(score)}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.point_id, r.score))
    return out


def check(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-9)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 16))
    p = rng.normal(size=(600, 16))
    p[:200] = p[0]  # a third of all points are copies of one
    p[201] = 0
    q[5] = p[0]
    q[6] = 0
    return q, p


@pytest.mark.parametrize("k", [1, 7, 700])
def test_both_routes_are_exact(spark, data, k):
    q, p = data
    queries = table(spark, [f"q{i:03d}" for i in range(len(q))], q, "query_id")
    points = table(spark, [f"p{i:04d}" for i in range(len(p))], p, "point_id").repartition(5)
    want = brute(q, p, k)
    check(found(vectors.vector_topk(queries, points, k)), want)
    check(found(vectors.knn_join(queries, points, k, group_rows=60, block=37)), want)


def spread_points(kind, n=4000, dim=24):
    rng = np.random.default_rng(9)
    if kind == "uniform":
        return rng.normal(size=(n, dim))
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.05


@pytest.mark.parametrize("kind, share", [("clustered", 0.15), ("uniform", 1.0)])
def test_bounds_hold_and_rule_out_groups(spark, kind, share):
    """No row passes its group's bound; on clustered vectors most groups are ruled out at the k-th score, on
    uniform ones hardly any can be, and the answer is the same."""
    p = spread_points(kind)
    q = spread_points(kind)[::80] + 0.001
    points = table(spark, [f"p{i:04d}" for i in range(len(p))], p, "point_id")
    placed, rings = groups.group_points(points, ["point_id"], group_rows=100)
    assert len(rings.grp) > 20 and rings.size.sum() == len(p)
    rows = placed.toPandas()
    unit_q = tiles.unit_rows(q.astype(np.float32).astype(float))
    cos = unit_q @ tiles.unit_rows(tiles.matrix(rows["embedding"])).T
    bound = rings.bounds(unit_q)[1]
    at = {g: k for k, g in enumerate(rings.grp)}
    assert (cos <= bound[:, [at[g] for g in rows["grp"]]] + 1e-7).all()
    kth = np.sort(cos, axis=1)[:, -10]
    visited = (bound >= kth[:, None]).mean()
    print(f"share of groups visited on {kind} vectors: {visited:.3f}")
    assert visited <= share
    queries = table(spark, [f"q{i:03d}" for i in range(len(q))], q, "query_id")
    check(found(vectors.knn_join(queries, points, 10, group_rows=100)), brute(q, p, 10))


@pytest.mark.parametrize("least", [-0.2, 0.5, 0.95])
def test_rows_above_a_cosine(spark, data, least):
    q, p = data
    queries = table(spark, [f"q{i:03d}" for i in range(len(q))], q, "query_id")
    points = spark.createDataFrame([(f"p{i}", f"o{i % 7}", [float(x) for x in v]) for i, v in enumerate(p)] + [("none", "o1", None)], "point_id string, owner string, embedding array<float>")
    got = [tuple(r) for r in vectors.rows_above(queries, points, least, "query_id", "point_id", "owner", block=50, group_rows=80).collect()]
    cos = tiles.unit_rows(q.astype(np.float32).astype(float)) @ tiles.unit_rows(p.astype(np.float32).astype(float)).T
    assert len(got) == len(set(got)) and set(got) == {(f"q{i:03d}", f"o{j % 7}") for i, j in zip(*np.nonzero(cos >= least))}


def test_beyond_the_broadcast_bound_the_join_is_used(spark, data):
    q, p = data
    queries = table(spark, [f"q{i:03d}" for i in range(len(q))], q, "query_id")
    points = table(spark, [f"p{i:04d}" for i in range(len(p))], p, "point_id")
    check(found(vectors.vector_topk(queries, points, 5, broadcast_elements=64)), brute(q, p, 5))


def test_no_points_and_no_queries(spark, data):
    q, p = data
    queries = table(spark, ["q000"], q[:1], "query_id")
    points = table(spark, ["p0000"], p[:1], "point_id")
    assert vectors.vector_topk(queries.where("false"), points, 3).count() == 0
    assert vectors.vector_topk(queries, points.where("false"), 3).count() == 0
    assert vectors.knn_join(queries, points.where("false"), 3).count() == 0


def test_hash_provider_is_deterministic_and_of_length_one(spark):
    rows = spark.createDataFrame([(1, "Red bolt red"), (2, "red  RED bolt"), (3, "")], "k int, t string")
    got = {r.k: np.array(r.embedding) for r in vectors.embed_hash(rows, "k", "t", 32).collect()}
    assert np.array_equal(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and 3 not in got


def test_many_queries_meet_parts_of_groups(spark, data, monkeypatch):
    """Blocks of queries beside parts of points, a large group cut into several, give the hits of brute force."""
    monkeypatch.setattr(tiles, "QUERY_BLOCK", 1024)
    p = data[1]
    q = np.random.default_rng(4).normal(size=(1300, 16))
    queries = table(spark, [f"q{i:03d}" for i in range(len(q))], q, "query_id")
    points = table(spark, [f"p{i:04d}" for i in range(len(p))], p, "point_id").repartition(3)
    check(found(vectors.knn_join(queries, points, 4, group_rows=30, part_rows=70)), brute(q, p, 4))


def test_a_task_holds_few_marks_and_cells_at_a_time(monkeypatch):
    """However many groups a query wants and points reach its bar, they are handed on by slices."""
    monkeypatch.setattr(tiles, "CELLS", 1000)
    unit = tiles.unit_rows(np.random.default_rng(5).normal(size=(300, 8)))
    slices = list(tiles.cells_above(unit, np.arange(100, 300), unit[:50], np.full(300, -0.2)))
    assert max(len(row) for row, _, _ in slices) <= 1000 and len(slices) == 10
    want = np.argwhere(unit[100:] @ unit[:50].T >= -0.2) + [100, 0]
    assert np.array_equal(np.concatenate([np.stack([r, c], axis=1) for r, c, _ in slices]), want)


def test_groups_are_packed_into_parts():
    rings = groups.Rings(np.arange(5), np.array([40, 50, 250, 30, 60]), None, None, None)
    first, pieces = rings.parts(100)
    assert first.tolist() == [0, 0, 1, 4, 4] and pieces.tolist() == [1, 1, 3, 1, 1]


def test_hash_provider_shuffles_no_words(spark):
    """One partial row of sums for a text, however many words it has; rows of one key are added up."""
    texts = [("a", " ".join(f"w{i}" for i in range(2000))), ("b", "red bolt"), ("b", "Red nut"), (None, "x"), ("c", None), ("d", " \t ")]
    rows = spark.createDataFrame(texts, "k string, t string")
    made = vectors.embed_hash(rows, "k", "t", 16)
    assert "Generate explode" not in made._jdf.queryExecution().toString()
    got = {r.k: np.array(r.embedding) for r in made.collect()}

    def plain(words):
        out = np.zeros(16)
        for h in (hashlib.md5(w.encode()).hexdigest() for w in words):
            out[int(h[:6], 16) % 16] += 1 if h[31] < "8" else -1
        return out / (np.linalg.norm(out) or 1)

    want = {"a": plain([f"w{i}" for i in range(2000)]), "b": plain("red bolt red nut".split()), None: plain(["x"])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
