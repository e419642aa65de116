"""How often rows of tables changed in place are shuffled, and how pages land."""

import glob

from noticelake.sources.store import BucketTable
from tests.test_store import SCHEMA, content, frame


def test_rows_are_merged_where_one_shuffle_puts_their_buckets(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "seq", buckets=4)
    plans, change = [], BucketTable._change
    def seen(self, rows, touched):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return change(self, rows, touched)
    monkeypatch.setattr(BucketTable, "_change", seen)
    table.upsert(frame(spark, [(1, "a", 1), (1, "b", 2), (None, "c", 1)]))
    table.upsert(frame(spark, [(1, "d", 3), (2, "e", 1)]), distinct=True)
    assert content(table) == sorted([(1, "d", 3), (2, "e", 1), (None, "c", 1)], key=repr)
    assert [(p.count("Exchange "), p.count("Exchange hashpartitioning(bucket")) for p in plans] == [(1, 1)] * 2


def test_landed_pages_are_compressed_and_come_in_batches(spark):
    from __spark_entry__ import queries
    from noticelake.session import stage_dir
    from tests.conftest import SF

    before = set(glob.glob(f"{stage_dir(spark)}/pages-*"))
    assert queries()["stream_notice_pages"](spark, SF).count() > 0
    root, = set(glob.glob(f"{stage_dir(spark)}/pages-*")) - before
    files = glob.glob(f"{root}/in/part-*")
    assert len(files) >= 4 and all(f.endswith(".gz") for f in files) and len(glob.glob(f"{root}/cp/commits/[0-9]*")) == 2
