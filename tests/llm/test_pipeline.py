"""The corpus pipeline's stages against their operators' own verdicts, and the queries' SQL."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, rows_of
from noticelake.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_against_sql(spark, key):
    df = QUERIES[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(ORACLES[key])
    assert rows_of([d[0] for d in cur.description], cur.fetchall()) == got


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).where("predicted = 1").collect()}
    groups = {r.component_id for r in QUERIES["op8_simhash_near_dedup"](spark, SF).collect()}
    bad = {r.doc_id for r in QUERIES["op9_benchmark_decontamination"](spark, SF).where("contaminated").collect()}
    every = ids(docs)
    kept = [stage(spark, docs, SF) for _, stage in corpus_pipeline.STAGES[:3]]
    assert all(k.columns == columns for k in kept)
    assert ids(kept[0]) == [i for i in every if i not in toxic]
    assert ids(kept[1]) == sorted(groups)
    assert ids(kept[2]) == [i for i in every if i not in bad]


def test_pipeline_runs_through(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096


def test_pipeline_keeps_no_near_copies(spark):
    """Documents 1 and 177 are 0.83 alike in five-word shingles and nine fingerprint bits apart."""
    import itertools

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda t: (t or "").lower().split()
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in docs.collect() if (w := words(r.text))}
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
    kept = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id in sets]
    assert 1 in kept and 177 not in kept
    assert not [(a, b) for a, b in itertools.combinations(kept, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
