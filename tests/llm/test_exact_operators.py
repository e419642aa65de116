"""Spelling variants, centroid clustering and exact top-k search against brute force, SQL and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import centroids, pivot_index, queries, variants
from noticelake.llm.common import ship
from tests.conftest import SF

DOCS = "doc_id long, text string, word string, n long"
VECTORS = "vec_id long, embedding array<float>, v string, cluster int, rid long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- 11 spelling variants ------------------------------------------------------------------------------------------


def counted(rows, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(word, alphabet):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet} | {a + c + b[1:] for a, b in cuts if b for c in alphabet}) - {word}


def grouped(n, ratio=10):
    alphabet = sorted({c for w in n for c in w})
    near = {w: [v for v in edits(w, alphabet) if v in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = grouped(counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = [tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] for r in got)


def test_variants_of_edge_rows(spark):
    long = "x" * 50_000
    texts = [None, "", "short words only", "Straße ÀÉÎÕÜÿ×÷ÀÉ", "Straße ÀÉÎÕÜÿ×÷ÀÉ", "received " * 40, "recieved recieved receved receved", f"{long} {long}y {long}"]
    rows = [(k, t, "clash", 9) for k, t in enumerate(texts * 3)] + [(None, "received nothing", None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    words = variants.noisy_words(docs, every=3)
    n = counted([(r[0], r[1]) for r in rows], every=3)
    assert {r.word: r.n for r in words.collect()} == n
    got = {tuple(r) for r in variants.group_variants(words).collect()}
    # Brute force over the words alone: one edit by the definition, for each pair.
    def one_edit(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]
    assert {(r[0], r[4]) for r in got} == {(w, sum(one_edit(w, v) for v in n)) for w in n}
    assert variants.group_variants(variants.noisy_words(docs.limit(0))).collect() == []


def test_roots_follow_forms_and_ties_go_to_the_first_word(spark):
    n = {"aaaaaaa": 5_000, "aaaaaab": 400, "aaaaabb": 30, "aaaabbb": 2, "zaaaaaab": 4_000, "q": 1, "r": 10, "s": 10}
    rows = [(w, k, "other") for w, k in n.items()] + [(None, 3, "other"), ("", 3, "other"), ("r", 0, "other")]
    got = {r.word: r for r in variants.group_variants(spark.createDataFrame(rows, "word string, n long, form string")).collect()}
    assert {tuple(r) for r in got.values()} == grouped(n)
    assert got["aaaabbb"].root == "aaaaaaa" and got["q"].form == "r"


def test_large_groups_are_compared_block_by_block(spark):
    rng = random.Random(5)
    n = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)): rng.randint(1, 99) for _ in range(700)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = [tuple(r) for r in variants.near_pairs(words, block=16).select("word", "near").collect()]
    alphabet = sorted({c for w in n for c in w})
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, v) for w in n for v in edits(w, alphabet) if v in n}
    assert {tuple(r) for r in variants.group_variants(words, block=16).collect()} == grouped(n)


# --- 12 centroid clustering ----------------------------------------------------------------------------------------


def clustered(rows, k, rounds, dim, scale, seed):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(float(np.float32(c)) * scale)) for c in x]))
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in kept[:k]]
    d = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda: [min((d(v, m), c) for c, m in enumerate(means)) for _, v in kept]
    for _ in range(rounds):
        at = near()
        means = [
            [sum(x) // len(x) for x in zip(*own)] if (own := [v for (_, v), (_, c2) in zip(kept, at) if c2 == c]) else m for c, m in enumerate(means)
        ]
    at = near()
    total = defaultdict(int)
    for dist, c in at:
        total[c] += dist
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted((i is not None, i or 0, c, dist, total[c], sum(total.values()), shas[c]) for (i, _), (dist, c) in zip(kept, at))


def vector_rows(seed, n, dim, spread=1.0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * spread
    x = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.1).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(n + k, rows[0][1]) for k in range(copies)] + [rows[1], rows[1], (None, rows[2][1]), (None, rows[2][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(9_001, None), (9_002, []), (9_003, [None] * dim), (9_004, [nan] * dim), (9_005, [inf] + [0.0] * (dim - 1)), (9_006, [0.0] * (dim + 1)), (9_007, [0.0] * dim)]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame([(i, x, "clash", 1, 2) for i, x in rows], VECTORS)


@pytest.mark.parametrize("seed, n, k, leading", [(1, 60, 8, 3), (2, 5, 40, 8), (3, 200, 40, 1)])
def test_clusters_against_brute_force(spark, seed, n, k, leading):
    rows = vector_rows(seed, n, 8, copies=30)
    got = centroids.cluster_vectors(vector_table(spark, rows), k=k, dim=8, leading=leading).collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got) == clustered(rows, k, 5, 8, 256, 2)


def test_clusters_of_no_rows(spark):
    table = vector_table(spark, vector_rows(1, 5, 8))
    assert centroids.cluster_vectors(table.limit(0), dim=8).collect() == []
    assert centroids.cluster_vectors(table, dim=99).collect() == []


def test_bounds_rule_centroids_out_and_never_the_nearest():
    rng = np.random.default_rng(0)
    v = rng.integers(-150, 150, (500, 32)) + 400 * rng.integers(-1, 2, (500, 1))
    means = v[:40].copy()
    basis = np.linalg.eigh(np.cov(v.T.astype(float)))[1][:, ::-1][:, :6]
    y, r = centroids.rotated(v.astype(float), v.mean(0), basis)
    cy, cr = centroids.rotated(means.astype(float), v.mean(0), basis)
    number, best, looked = centroids.nearest(v, y, r, means, cy, cr)
    whole = ((v[:, None] - means) ** 2).sum(2)
    assert (number == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert looked < 0.7 * whole.size


# --- 13 exact top-k search -----------------------------------------------------------------------------------------


def products(rows, every, k, scale=256):
    kept = [(i, [int(np.floor(float(np.float32(c)) * scale)) for c in x]) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is not None and q % every == 0:
            scores = sorted((-sum(c * d for c, d in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(kept) if a != b and len(y) == len(x))
            out += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, n, spread, pivots", [(1, 80, 1.0, None), (2, 300, 5.0, 9), (3, 3, 0.0, 4)])
def test_search_against_brute_force(spark, monkeypatch, seed, n, spread, pivots):
    monkeypatch.setattr(pivot_index, "CHUNK", 7)
    rows = vector_rows(seed, n, 8, spread, copies=25)
    got = pivot_index.top_products(vector_table(spark, rows), F.col("vec_id") % 7 == 0, pivots=pivots).collect()
    assert sorted(map(tuple, got), key=repr) == products(rows, 7, 5)


def test_search_of_no_rows(spark):
    table = vector_table(spark, vector_rows(1, 5, 8))
    assert pivot_index.top_products(table.limit(0), F.col("vec_id") % 7 == 0).collect() == []
    assert pivot_index.top_products(table, F.lit(None).cast("boolean")).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(k, [100_000.0 + k / 256, -100_000.0, k * 1.0]) for k in range(40)] + [(99, [1e30, 0.0, 0.0])]
    got = pivot_index.top_products(vector_table(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == products(rows[:-1], 10, 5)


def test_far_annuli_are_not_looked_at(spark):
    rng = np.random.default_rng(4)
    turns = np.linalg.qr(rng.normal(size=(32, 32)))[0][:30] * 3
    x = turns[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 0.02
    rows = [(k, [float(c) for c in v.astype(np.float32)]) for k, v in enumerate(x)]
    table = vector_table(spark, rows)
    looked = pivot_index.searched(table, F.col("vec_id") % 50 == 0, 5, 256, "vec_id", "embedding", 30).agg(F.sum("looked")).first()[0]
    assert looked < 0.25 * 60 * 3000
    got = pivot_index.top_products(table, F.col("vec_id") % 50 == 0, pivots=30).collect()
    assert sorted(map(tuple, got), key=repr) == products(rows, 50, 5)
