"""Trimming and cutting of texts without a pattern tried at every character."""

from pyspark.sql import functions as F

from noticelake.functions import display, text as tx
from noticelake.sources import pages


def test_trimming_is_that_of_the_pattern_without_one(spark):
    char = F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")
    every = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.concat(char, F.lit("a b"), char).alias("t"))
    pattern = F.regexp_replace("t", rf"\A{tx.WS}+|{tx.WS}+\z", "")
    assert every.where(tx.strip("t") != pattern).count() == 0 and every.where(F.length(tx.strip("t")) == 3).count() == 29
    n = spark.createDataFrame([(" A\r\n", "b\rc\n\r\nd \u2003"), ("t", None)], "title string, description string").select(display.embedding_text().alias("e"))
    assert [r.e for r in n.collect()] == ["A   b c  d", "t"]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan(n)
    read = pages.notice_fields(spark.createDataFrame([("u", "<p>")], "url string, html string"))
    assert "RLIKE" not in plan(read) and read.first().title == "Untitled"
