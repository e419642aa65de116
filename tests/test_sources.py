"""File sources, sinks and streams on small fixtures."""

import json

from pyspark.sql import functions as F

import pytest

from noticelake.operators.state import insert_if_absent
from noticelake.session import stage_dir
from noticelake.operators import ingest
from noticelake.sources import files, notices, pages
from noticelake.streaming import jobs

AS_OF = "2024-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


CSV = '''Notice Identifier,Title,Status,Published Date,Closing Date,Value Low,Value High,Description,Suitable for SME
A1,First ,Open,2024-05-01T10:00:00Z,2024-07-01T10:00:00Z,0,"£2,000.00","Line one
line ""two"", end",Yes
A2,Second, OPEN ,01/05/2024,01/07/2024,abc,,,n
A3,Closed,Closed,01/05/2024,01/07/2024,1,2,,
A4,Naive,Open,01/05/2024,2024-07-01T10:00:00,1,2,,
A5,Late,Open,01/05/2024,01/05/2024,1,2,,
A6,No date,Open,,01/07/2024,1,2,,
,No id,Open,01/05/2024,01/07/2024,1,2,,
'''


def test_csv_source(spark, tmp_path):
    path = tmp_path / "notices.csv"
    path.write_text(CSV, encoding="utf-8")
    raw = notices.scan_notices_csv(spark, str(path), CSV.splitlines()[0].split(","))
    assert raw.columns == list(notices.CSV_COLUMNS) and raw.count() == 7
    parsed = ingest.parse_csv_notices(raw)
    kept = {r.notice_id: r for r in ingest.filter_open_csv(parsed, as_of()).collect()}
    assert set(kept) == {"A1", "A2", "UNKNOWN"}
    assert kept["A1"].value == 2000.0 and kept["A1"].value_low == 0.0
    assert kept["A1"].description == 'Line one line "two", end' and kept["A1"].suitable_for_sme is True
    assert kept["A2"].value is None and kept["A2"].buyer_name == "Unknown Buyer" and kept["A2"].suitable_for_sme is False
    with_utc = {r.notice_id for r in ingest.filter_open_csv(parsed, as_of(), "utc").collect()}
    assert with_utc == {"A1", "A2", "A4", "UNKNOWN"}
    rejected = {r.notice_id: r.reason for r in ingest.rejected_csv(parsed, as_of()).collect()}
    assert rejected == {"A3": "not open", "A4": "closing date without offset", "A5": "closed", "A6": "no published date"}


def release(ident, status="active", end="2024-07-01T00:00:00Z", date="2024-05-01T00:00:00Z", **extra):
    tender = {"title": f"T{ident}", "description": "d", "status": status, "value": {"amount": 5.5},
              "items": [{"classification": {"scheme": "CPV", "id": "1"}}, {"classification": {"scheme": "X", "id": "2"}}],
              "deliveryAddresses": [{"region": "North"}, {"region": "South"}]}
    if end:
        tender["tenderPeriod"] = {"endDate": end}
    return {"id": ident, "date": date, "buyer": {"name": "B"}, "tender": tender, **extra}


def test_ocds_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"releases": [release("1"), release("2", status="complete")], "links": {"next": "x"}}))
    (tmp_path / "b.json").write_text(json.dumps([release("3", end=None), release("4", end="2024-01-01T00:00:00Z"), release("5", end="2024-07-01")]))
    (tmp_path / "c.json").write_text("[]")
    rows = notices.scan_ocds_json(spark, str(tmp_path))
    assert rows.count() == 5
    kept = {r.notice_id: r for r in ingest.filter_active_ocds(ingest.flatten_ocds(rows), as_of()).collect()}
    assert set(kept) == {"1", "3"}
    assert kept["1"].cpv_codes == ["1"] and kept["1"].region == "North" and kept["1"].value == 5.5


def test_uploads(spark, tmp_path):
    (tmp_path / "ok.TXT").write_text("hello there")
    (tmp_path / "bad.exe").write_text("x")
    (tmp_path / "fake.pdf").write_text("not a pdf")
    got = {r.path.rsplit("/", 1)[-1]: (r.file_type, r.text) for r in files.scan_uploads(spark, str(tmp_path)).where("reject_reason is null").collect()}
    assert got == {"ok.TXT": ("txt", "hello there"), "fake.pdf": ("pdf", None)}
    listed = spark.createDataFrame([("application/pdf", 10, None), ("text/plain", 10, "short"), ("image/png", 1, None), ("text/plain", 99, "long enough text")], "mime string, length long, text string")
    assert [r.reject_reason for r in files.screen_by_mime(listed).collect()] == [None, "too short", "unsupported type", None]


HTML = """<h1 class="govuk-heading-l">Road &amp; bridge <b>works</b></h1>
<div class="govuk-grid-column-three-quarters"><ul class="govuk-list"><li>Leeds Council</li><li>x</li></ul></div>
<h3>Notice identifier:</h3><p>2024/S 1</p><h3>Published</h3> <p>1 May</p><h3>Description</h3><div>All <i>roads</i></div>
<h3>Contract value</h3><ul><li>£5</li><li>£6 </li></ul>
<h3 id="supplier_or_tenderer_0">Acme</h3><div class="govuk-body"><p>1 Street</p><p>Town</p><a href="mailto:a@b.c">m</a></div>
<h3 id="contracting_authority_0">Leeds</h3><div class="govuk-body"><a href="mailto:l@b.c">m</a><a href="http://leeds.example">w</a></div>"""


def test_notice_page(spark):
    df = spark.createDataFrame([("https://x/Notice/009-2024?origin=a", HTML), ("https://x/Notice/1", "<p>nothing</p>")], "url string, html string")
    full, empty = [r.asDict() for r in pages.notice_fields(df).collect()]
    assert full == {
        "url": "https://x/Notice/009-2024?origin=a", "tender_id": "009-2024", "title": "Road & bridge works", "publishing_authority": "Leeds Council",
        "notice_id": "2024/S 1", "published_date": "1 May", "reference": "", "description": "All roads", "award_decision_date": "Unknown",
        "contract_value": ["£5", "£6"], "contract_dates": [], "supplier_name": "Acme", "supplier_address": ["1 Street", "Town"], "supplier_email": "a@b.c",
        "authority_name": "Leeds", "authority_address": ["Unknown"], "authority_email": "l@b.c", "authority_website": "http://leeds.example",
    }
    assert empty["title"] == "Untitled" and empty["supplier_email"] == "Unknown" and empty["contract_value"] == []


def run_stream(spark, root, per_batch):
    stream = jobs.notice_page_stream(spark, str(root / "in"), as_of(), files_per_batch=per_batch)
    path = str(root / f"table{per_batch}")
    jobs.append_stream(stream, path, str(root / f"cp{per_batch}")).awaitTermination()
    latest = jobs.latest_versions(spark, path, "notice_id", "published_date")
    return sorted((r.notice_id, r.title, str(r.published_date)) for r in latest.collect())


def test_stream_does_not_depend_on_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for day in range(1, 7):
        page = [release(str(i), date=f"2024-05-0{day}T00:00:00Z") for i in range(day, day + 3)]
        (folder / f"p{day}.json").write_text(json.dumps({"releases": page}))
    whole = run_stream(spark, tmp_path, 100)
    assert whole == run_stream(spark, tmp_path, 1)
    assert {n: d for n, _, d in whole}["3"] == "2024-05-03 00:00:00" and len(whole) == 8


def test_stream_keeps_notices_of_a_whole_year(spark, tmp_path):
    """Newest first and one file a batch: no notice is too old to be kept."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n, month in enumerate((11, 9, 7, 5, 3, 1)):
        (folder / f"p{n}.json").write_text(json.dumps({"releases": [release(str(month), date=f"2024-{month:02d}-01T00:00:00Z")]}))
    assert {n for n, _, _ in run_stream(spark, tmp_path, 1)} == {"1", "3", "5", "7", "9", "11"}


def test_insert_if_absent_takes_one_of_tied_rows(spark):
    state = spark.createDataFrame([("b", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 4, 1)], "id string, v int, seq int")
    kept, rejected = insert_if_absent(state, new, "id", "seq")
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]
    assert rejected.count() == 3


def test_staging_needs_a_shared_folder():
    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_dir(Unset())


def test_upsert_is_idempotent(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, seq int")
    once = ingest.upsert(state, batch, "id", "seq")
    assert sorted(once.collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(ingest.upsert(once, batch, "id", "seq").collect()) == sorted(once.collect())


def test_rejected_uploads_keep_a_row(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * (files.UPLOAD_MAX_BYTES + 1))
    (tmp_path / "edge.txt").write_bytes(b"x" * files.UPLOAD_MAX_BYTES)
    (tmp_path / "page.html").write_text("<p>no upload type</p>")
    got = {r.path.rsplit("/", 1)[-1]: (r.reject_reason, r.content is None) for r in files.scan_uploads(spark, str(tmp_path)).collect()}
    assert got == {"big.txt": ("too large", True), "edge.txt": (None, False), "page.html": ("unsupported type", True)}


def test_rejected_releases_keep_their_reason(spark, tmp_path):
    page = [release("1"), release("2", date=None), release("3", date="soon")]
    (tmp_path / "p.json").write_text(json.dumps({"releases": page}))
    flat = ingest.flatten_ocds(notices.scan_ocds_json(spark, str(tmp_path)))
    kept = {r.notice_id for r in ingest.filter_active_ocds(flat, as_of()).collect()}
    gone = {r.notice_id: r.reason for r in ingest.rejected_ocds(flat, as_of()).collect()}
    assert kept == {"1"} and gone == {"2": "no published date", "3": "no published date"}


@pytest.mark.parametrize("query, folder", [("scan_ocds_json", "ocds-*"), ("concat_pages", "release-pages-*/half=*"), ("ocds_sync", "releases-*")])
def test_release_texts_are_written_compressed(spark, query, folder):
    """Every release passes through a file; as plain text they would take several times the disk."""
    import glob

    from checks.catalog import QUERIES
    from checks.views import Views
    from noticelake.session import stage_dir

    listed = lambda: set(glob.glob(f"{stage_dir(spark).removeprefix('file:')}/{folder}/part-*"))
    before = listed()
    QUERIES[query](Views(spark, "/root/testdata/sf0.001"))
    assert (made := listed() - before) and all(f.endswith(".gz") for f in made)
