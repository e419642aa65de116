"""Files read in many splits against the same files read whole."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from noticelake.sources import notices as src, splitting


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def messy(rng):
    parts = ["Leeds", 'the "best"', "a,b", "\n", "\r\n", '""', "£5", "", " ", "x" * rng.choice([1, 1, 1, 300, 4500]), "\n\n", "漢字"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))


@pytest.mark.parametrize("seed, line_end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_split_csv_equals_the_whole_read(spark, tmp_path, small_splits, seed, line_end):
    rng = random.Random(seed)
    wanted = []
    for n in range(2):
        rows = [[messy(rng) for _ in src.CSV_COLUMNS] for _ in range(60)]
        rows = [[f"id{n}-{k}", *r[1:]] for k, r in enumerate(rows)]
        wanted += rows
        with open(tmp_path / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=line_end)
            out.writerow(src.CSV_COLUMNS)
            out.writerows(rows)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    got = src.scan_notices_csv(spark, str(tmp_path))
    assert rows_of(got) == rows_of(whole.select(*[F.col(f"`{c}`") for c in src.CSV_COLUMNS]))
    assert {r["Notice Identifier"] for r in got.collect()} == {r[0] for r in wanted}
    assert splitting.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert splitting.quoted_records(spark, str(tmp_path)).where("block > 0").select("file", "block").distinct().count() > 10


def test_csv_of_other_headers_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Notice Identifier\n"two\nlines",n1\n\nplain,n2', encoding="utf-8")
    got = {r["Notice Identifier"]: r.Title for r in src.scan_notices_csv(spark, str(tmp_path), ["Title", "Notice Identifier"]).collect()}
    assert got == {"n1": "two\nlines", "n2": "plain"}
    with pytest.raises(Exception, match="unexpected CSV header"):
        src.scan_notices_csv(spark, str(tmp_path), ["Notice Identifier", "Title"]).collect()
    (tmp_path / "a.csv").write_text("", encoding="utf-8")
    assert src.scan_notices_csv(spark, str(tmp_path)).collect() == []


def nasty_release(rng, k):
    texts = ['plain', 'a "quoted" {brace} [x]', '\\', '"', '}{', ']}', 'line\nbreak', '"releases": [{"id":"fake"}]', "漢字", "y" * rng.choice([1, 400, 5000])]
    text = lambda: "".join(rng.choice(texts) for _ in range(rng.randint(0, 4)))
    return {"id": f"R{k}", "date": "2024-05-01T00:00:00Z", "buyer": {"name": text()}, "tender": {
        "title": text(), "status": "active", "items": [{"classification": {"scheme": "CPV", "id": text()}} for _ in range(rng.randint(0, 3))],
        "deliveryAddresses": [{"region": text()}]}, "extra": {"releases": [{"id": "inner"}], "deep": [[{"a": [1, {"b": "}"}]}]]}}


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 1), (3, None)])
def test_split_json_equals_the_whole_read(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    some = lambda n: [nasty_release(rng, rng.randint(0, 10**9)) for _ in range(n)]
    values = {
        "package": {"uri": 'x "releases": [', "tags": [{"id": "no"}, {"releases": [{"id": "no"}]}], "releases": some(60), "after": [{"id": "no"}], "links": {"next": "n"}},
        "array": some(40), "bare": some(1)[0], "empty": {"releases": []}, "none": [], "one": {"releases": some(1)}, "packages": [{"releases": some(5)}, {"releases": some(4)}],
    }
    for name, value in values.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, ensure_ascii=seed == 1, indent=indent), encoding="utf-8")
    whole = src.releases(spark.read.schema(src.PACKAGE).option("multiLine", True).json(str(tmp_path)))
    got = src.scan_ocds_json(spark, str(tmp_path))
    assert rows_of(got) == rows_of(whole) and got.count() == 60 + 40 + 1 + 1 + 9
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
