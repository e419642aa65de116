"""Tables changed in place: what is rewritten, replays, any order of batches, and a writer that dies."""

import glob
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from noticelake.operators import ingest
from noticelake.sources import notices as src
from noticelake.sources.store import BucketTable
from noticelake.streaming import jobs

SCHEMA = "id long, name string, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(root):
    return {os.path.relpath(f, root) for f in glob.glob(f"{root}/data/bucket=*/*.parquet")}


def content(table):
    rows = [tuple(r) for r in table.read().collect()]
    assert len(rows) == len({r[0] for r in rows})
    return sorted(rows, key=repr)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "seq", buckets=16)
    assert content(table) == [] and table.upsert(frame(spark, [])) == 0
    assert table.upsert(frame(spark, [(k, f"a{k}", 1) for k in range(200)])) == 16
    before = files(tmp_path / "t")
    assert table.upsert(frame(spark, [(3, "b3", 2), (3, "older", 1), (700, "new", 1), (None, "nobody", 1)])) <= 3
    after = files(tmp_path / "t")
    touched = {f.split("/")[1] for f in before - after}
    assert 1 <= len(touched) <= 3 and {f for f in before if f.split("/")[1] not in touched} <= after
    want = {k: (k, f"a{k}", 1) for k in range(200)} | {3: (3, "b3", 2), 700: (700, "new", 1), None: (None, "nobody", 1)}
    assert content(table) == sorted(want.values(), key=repr)
    assert table.delete(frame(spark, [(3, None, None), (10_000, None, None)])) <= 2
    del want[3]
    assert content(table) == sorted(want.values(), key=repr)
    table.delete(table.read().where("id IS NOT NULL"))
    assert content(table) == [(None, "nobody", 1)] and len(files(tmp_path / "t")) == 1
    table.clear()
    assert content(table) == []


def test_any_order_and_replays_give_one_table(spark, tmp_path):
    batches = [[(1, "x", 1), (2, "x", 5)], [(1, "y", 3), (3, "y", 1)], [(1, "z", 2), (2, "z", 5), (3, "w", 1)]]
    seen = set()
    for n, order in enumerate(itertools.permutations(range(3))):
        table = BucketTable(spark, str(tmp_path / f"o{n}"), SCHEMA, ["id"], "seq", buckets=4)
        for k in [*order, order[0], order[2]]:
            table.upsert(frame(spark, batches[k]))
        seen.add(tuple(content(table)))
    assert len(seen) == 1 and (1, "y", 3) in next(iter(seen))


def test_a_change_that_was_marked_is_finished_and_one_that_was_not_is_dropped(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = BucketTable(spark, root, SCHEMA, ["id"], "seq", buckets=4)
    table.upsert(frame(spark, [(k, "a", 1) for k in range(20)]))
    with monkeypatch.context() as m:
        calls = iter([None])
        m.setattr(table, "_finish", lambda: next(calls))  # dies after the marker
        with pytest.raises(StopIteration):
            table.upsert(frame(spark, [(1, "b", 2)]))
    assert [os.path.exists(f"{d}/touched.json") for d in glob.glob(f"{root}/_staged/*")] == [True]
    os.makedirs(f"{root}/_staged/half/rows")  # never got a marker
    again = BucketTable(spark, root, SCHEMA, ["id"], "seq", buckets=4)
    assert (1, "b", 2) in content(again) and len(content(again)) == 20 and not glob.glob(f"{root}/_staged/*")


def release(k, day, amount):
    return {"id": f"R{k}", "date": f"2024-05-{day:02d}T00:00:00Z", "buyer": {"name": "Leeds"}, "tender": {
        "title": f"T{k}", "status": "active", "tenderPeriod": {"endDate": "2030-01-01T00:00:00Z"}, "value": {"amount": amount}}}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_streamed_pages_are_upserted_batch_by_batch(spark, tmp_path, order):
    pages = [[release(1, 1, 10), release(2, 1, 20)], [release(1, 3, 11), release(3, 1, 30)], [release(1, 2, 12), release(2, 4, 21)]]
    landed = tmp_path / "in"
    landed.mkdir()
    as_of = F.lit("2024-06-01").cast("timestamp")
    stream = lambda: jobs.notice_page_stream(spark, str(landed), as_of, files_per_batch=1)
    table = BucketTable(spark, str(tmp_path / "t"), stream().schema, ["notice_id"], "published_date", buckets=8)
    for n in order:
        (landed / f"{n}.json").write_text(json.dumps({"releases": pages[n]}))
        jobs.upsert_stream(stream(), table, str(tmp_path / "cp")).awaitTermination()
    latest = lambda: {r.notice_id: r.value for r in table.read().collect()}
    assert latest() == {"R1": 11.0, "R2": 21.0, "R3": 30.0}
    # The same pages once more, as if no batch had been checkpointed.
    before = files(tmp_path / "t")
    jobs.upsert_stream(stream(), table, str(tmp_path / "cp2")).awaitTermination()
    assert latest() == {"R1": 11.0, "R2": 21.0, "R3": 30.0} and len(files(tmp_path / "t")) == len(before)
