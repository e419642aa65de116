from pyspark.sql import functions as F

from checks.views import Views
from noticelake.operators import scoring
from tests.conftest import SF


def _rows(df):
    return sorted((r.firm_id, r.notice_id, r.reasons_page, tuple(r.match_reasons)) for r in df.collect())


def test_texts_meet_pairs_once_and_pairs_are_scored_once(spark):
    t = Views(spark, SF).scoring_tables
    pairs = Views(spark, SF).pairs.limit(300).localCheckpoint()
    scored = scoring.score_pairs(pairs, **t).localCheckpoint()
    judged = scoring.with_preferences(pairs, t["notices"], t["preferences"]).localCheckpoint()
    # Judged pairs need no text again: there is none to search.
    lean = t["notices"].drop("title", "description")
    again = scoring.score_pairs(pairs, **(t | {"notices": lean}), judged=judged)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, scored.collect()), key=str)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(x):
        calls.add(1)
        return x

    counted = scored.withColumn("total_score", count.asNondeterministic()("total_score"))
    made = _rows(scoring.with_reasons(counted, lean, t["past_wins"], t["preferences"], judged))
    assert made == _rows(scoring.with_reasons(scored, t["notices"], t["past_wins"], t["preferences"]))
    assert calls.value == scored.count() > 0
