"""Golden rows for the field parsers, one per branch."""

import datetime

from pyspark.sql import functions as F

from noticelake.functions import display, text as tx


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.select("i", expr.alias("r")).orderBy("i").select("r").collect()]


DATES = [
    ("2023-02-15T09:55:27Z", "2023-02-15 09:55:27", False),
    ("2022-07-26T10:17:59+01:00", "2022-07-26 09:17:59", False),
    ("2022-07-26T10:17:59", "2022-07-26 10:17:59", True),
    ("2022-07-26T10:17:59.250-02:00", "2022-07-26 12:17:59.250000", False),
    ("2022-07-26T10:17", None, False),
    ("2022-07-26T10:17+01:00", "2022-07-26 09:17:00", False),
    ("25/12/2024", "2024-12-25 00:00:00", False),
    ("5/1/2024", "2024-01-05 00:00:00", False),
    ("25-12-2024", "2024-12-25 00:00:00", False),
    ("2024-12-25", "2024-12-25 00:00:00", False),
    (" 25/12/2024 10:00:00\t", "2024-12-25 10:00:00", False),
    ("31/02/2024", None, False),
    ("soon", None, False),
    ("", None, False),
    ("  \n", None, False),
    (None, None, False),
]


def test_dates(spark):
    got = one(spark, [d[0] for d in DATES], tx.parse_notice_date("c"))
    for (source, want, naive), row in zip(DATES, got):
        ts = row["ts"] and row["ts"].replace(tzinfo=None)
        assert (ts and str(ts)) == want, source
        if source:
            assert row["is_naive"] is naive, source


def test_money(spark):
    values = ["£1,234.50", "0", " £7 ", "abc", "", None, "nan", "inf", "-5", "1e3"]
    assert one(spark, values, tx.parse_money("c")) == [1234.5, 0.0, 7.0, None, None, None, None, None, -5.0, 1000.0]


def test_booleans(spark):
    values = ["Yes", "n", "maybe", "", None, " TRUE ", "0", "1"]
    assert one(spark, values, tx.parse_bool("c")) == [True, False, None, None, None, True, False, True]


def test_lists(spark):
    assert one(spark, ["a;b, c,,", None, "", " ; "], tx.parse_list("c")) == [["a", "b", "c"], [], [], []]


def test_cleaning_counts_every_kind_of_space(spark):
    values = ["  a    b\x1c\nc ", "　", "", None]
    assert one(spark, values, tx.clean_field("c")) == ["a b c", None, None, None]


def test_pick_value_takes_zero_for_missing(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (3.0, 5.0), (None, 5.0), (0.0, None)], "lo double, hi double")
    assert [r[0] for r in rows.select(tx.pick_value("lo", "hi")).collect()] == [5.0, 3.0, 5.0, None]


def test_filename_metadata(spark):
    rows = spark.createDataFrame(
        [("EMP-2024-001_contract.pdf", None), ("x_NDA_policy.txt", {"document_type": "mine"})], "f string, u map<string,string>"
    )
    a, b = [r[0] for r in rows.select(tx.filename_metadata("f", "u")).collect()]
    assert a == {"filename": "EMP-2024-001_contract.pdf", "case_id": "EMP-2024-001", "document_type": "contract"}
    assert b == {"filename": "x_NDA_policy.txt", "document_type": "mine"}


def test_display(spark):
    assert one(spark, [None, 1234.5, 1235.5, 0.4], display.format_value("c"), "double") == ["Not specified", "£1,234", "£1,236", "£0"]
    assert one(spark, ["text", "12"], display.format_value("c")) == ["text", "£12"]
    assert one(spark, [0.57, None, 0.0, 1.0], display.percent("c"), "double") == [56, 0, 0, 100]
    assert one(spark, [0.125, 0.5], display.percent_text("c"), "double") == ["12%", "50%"]
    stamp = datetime.datetime(2024, 3, 5, 10)
    assert one(spark, [stamp, None], display.format_deadline("c"), "timestamp") == ["05 March 2024", "Not specified"]


def test_is_new_boundaries(spark):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    day = datetime.datetime(2024, 1, 10)
    values = [day - datetime.timedelta(days=7, hours=23), day - datetime.timedelta(days=8), day + datetime.timedelta(days=3), None]
    assert one(spark, values, display.is_new("c", as_of), "timestamp") == [True, False, True, False]
