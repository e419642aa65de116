"""Lists gathered per key, in pages of bounded length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.session import staged

PAGE_ROWS = 10_000


def paged_lists(
    rows: DataFrame, key: list[str], fields: list[str], name: str, page: str = "page", size: int = PAGE_ROWS
) -> DataFrame:
    """``(key, page, name)`` with sorted lists of the ``fields``.

    Page n holds the rows from n * ``size`` on in the order of the fields, so the lists of a key
    run on from page to page. A key whose rows fill one page is gathered as it is; the rows of larger
    keys are ranked by ranges of key and fields, so the rows of one key are ranked in many tasks and
    only a page is ever held.
    """
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias(name)
    lean = rows.select(*key, *fields)
    # One row for each key that fills more than a page.
    large = staged(lean.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select(*key), "large-lists")
    if not large.limit(1).count():
        return lean.groupBy(*key).agg(listed).select(*key, F.lit(0).alias(page), name)
    same = reduce(lambda a, b: a & b, [lean[k].eqNullSafe(large[k]) for k in key])
    small = lean.join(large, same, "left_anti").groupBy(*key).agg(listed).select(*key, F.lit(0).alias(page), name)
    ranked = ranks(lean.join(large, same, "left_semi"), key, fields)
    paged = ranked.withColumn(page, F.floor(F.col("_rank") / size).cast("int")).groupBy(*key, page).agg(listed)
    return small.unionByName(paged.select(*key, page, name))


def ranks(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, each row's place from 0 among the rows of its key by the fields (equal rows in any
    order), and the ``_range`` it was ranked in.

    Rows are dealt out by ranges of key, fields and a number that parts equal rows. A range knows the
    ranks in itself; the rows of a key in earlier ranges, one number for each range, are added.
    """
    numbered = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows-to-rank")
    # Written once: what range a row is in must not change between the counts and the ranks.
    dealt = staged(numbered.repartitionByRange(*key, *fields, "_row").withColumn("_range", F.spark_partition_id()), "ranged-rows")
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_range").alias("_r"), "_before")
    within = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*fields, "_row"))
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], F.col("_range") == F.col("_r"))
    return dealt.withColumn("_within", within).join(starts, met).select(
        *rows.columns, "_range", (F.col("_before") + F.col("_within") - 1).alias("_rank")
    )
