"""Lists in pages against a plain restatement, with a key that holds most rows."""

import random

import pytest

from noticelake.operators.lists import paged_lists, ranks


def hot_rows(seed=1, n=900):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    return [(key(), rng.choice([1, 1, 2]), rng.randint(0, 50), rng.choice(["x", "y", None])) for _ in range(n)] + [("hot", 1, 7, "same")] * 200


SCHEMA = "k string, g int, a int, b string"


@pytest.mark.parametrize("size", [10_000, 100, 7])
def test_pages_run_on_in_order(spark, size):
    rows = hot_rows()
    got = {(r.k, r.g, r.page): [tuple(e) for e in r.held] for r in paged_lists(spark.createDataFrame(rows, SCHEMA), ["k", "g"], ["a", "b"], "held", size=size).collect()}
    none_first = lambda r: tuple((x is not None, x) for x in r)
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r[2:] for r in rows if r[:2] == key), key=none_first)
        for at in range(0, len(own), size):
            want[(*key, at // size)] = own[at:at + size]
    assert got == want


def test_a_hot_key_is_ranked_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would share a task
    try:
        ranked = ranks(spark.createDataFrame(hot_rows(), SCHEMA), ["k"], ["a", "b"]).where("k = 'hot'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r._rank for r in ranked) == list(range(len(ranked)))
    assert len({r._range for r in ranked}) > 3


def test_no_rows(spark):
    assert paged_lists(spark.createDataFrame([], SCHEMA), ["k"], ["a"], "held").collect() == []
