"""Raw notices to typed, filtered, deduplicated notice rows and points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions import display, text as tx

DEFAULTS = {"notice_id": "UNKNOWN", "title": "Untitled Contract", "buyer_name": "Unknown Buyer"}

# Columns of a notice row, in payload order.
NOTICE_COLUMNS = (
    "notice_id", "title", "description", "buyer_name", "published_date", "closing_date", "closing_time",
    "start_date", "end_date", "value", "value_low", "value_high", "region", "postcode", "cpv_codes",
    "notice_type", "contact_name", "contact_email", "contact_phone", "contact_address", "contact_website",
    "additional_text", "attachments", "links", "suitable_for_sme", "suitable_for_vco",
)
HOISTED = ("notice_id", "buyer_name", "value", "region")


def _with_default(name: str, raw) -> Column:
    return F.coalesce(tx.clean_field(raw), F.lit(DEFAULTS[name])).alias(name)


def parse_csv_notices(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of the raw CSV rows, plus ``status``, ``closing_naive`` and the columns in ``keep``.
    Drops no row."""
    c = lambda name: F.col(f"`{name}`")
    stage = raw.withColumns(
        {
            "_published": tx.parse_notice_date(c("Published Date")),
            "_closing": tx.parse_notice_date(c("Closing Date")),
            "_start": tx.parse_notice_date(c("Start Date")),
            "_end": tx.parse_notice_date(c("End Date")),
            "_low": tx.parse_money(c("Value Low")),
            "_high": tx.parse_money(c("Value High")),
        }
    )
    field = lambda name, heading: tx.clean_field(c(heading)).alias(name)
    return stage.select(
        _with_default("notice_id", c("Notice Identifier")),
        _with_default("title", c("Title")),
        field("description", "Description"),
        _with_default("buyer_name", c("Organisation Name")),
        F.col("_published.ts").alias("published_date"),
        F.col("_closing.ts").alias("closing_date"),
        field("closing_time", "Closing Time"),
        F.col("_start.ts").alias("start_date"),
        F.col("_end.ts").alias("end_date"),
        tx.pick_value("_low", "_high").alias("value"),
        F.col("_low").alias("value_low"),
        F.col("_high").alias("value_high"),
        field("region", "Region"),
        field("postcode", "Postcode"),
        tx.parse_list(c("Cpv Codes")).alias("cpv_codes"),
        field("notice_type", "Notice Type"),
        field("contact_name", "Contact Name"),
        field("contact_email", "Contact Email"),
        field("contact_phone", "Contact Telephone"),
        tx.join_parts(
            c("Contact Address 1"), c("Contact Address 2"), c("Contact Town"), c("Contact Postcode"), c("Contact Country")
        ).alias("contact_address"),
        field("contact_website", "Contact Website"),
        field("additional_text", "Additional Text"),
        field("attachments", "Attachments"),
        field("links", "Links"),
        tx.parse_bool(c("Suitable for SME")).alias("suitable_for_sme"),
        tx.parse_bool(c("Suitable for VCO")).alias("suitable_for_vco"),
        F.lower(tx.strip(c("Status"))).alias("status"),
        F.col("_closing.is_naive").alias("closing_naive"),
        *keep,
    )


def csv_reject_reason(as_of: Column, naive: str = "drop") -> Column:
    """Why a parsed CSV row is not an open notice; null when it is one."""
    unusable = F.col("closing_naive") if naive == "drop" else F.lit(False)
    return (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "open", "not open")
        .when(F.col("closing_date").isNull(), "no closing date")
        .when(unusable, "closing date without offset")
        .when(F.col("closing_date") < as_of, "closed")
        .when(F.col("published_date").isNull(), "no published date")
    )


def filter_open_csv(parsed: DataFrame, as_of: Column, naive: str = "drop") -> DataFrame:
    return parsed.where(csv_reject_reason(as_of, naive).isNull())


def rejected_csv(parsed: DataFrame, as_of: Column, naive: str = "drop") -> DataFrame:
    reason = csv_reject_reason(as_of, naive)
    return parsed.where(reason.isNotNull()).select("notice_id", reason.alias("reason"))


def cpv_items(items) -> Column:
    """Ids of the items classified under CPV, in order."""
    listed = F.coalesce(tx.col(items), F.array())
    cpv = F.filter(listed, lambda i: i["classification"]["scheme"] == "CPV")
    return F.transform(cpv, lambda i: F.coalesce(i["classification"]["id"], F.lit("")))


def first_region(addresses) -> Column:
    return F.try_element_at(tx.col(addresses), F.lit(1))["region"]


def flatten_ocds(releases: DataFrame) -> DataFrame:
    """One row per release with typed notice columns and the fields the filter needs. Keeps all rows."""
    stage = releases.withColumns(
        {"_published": tx.parse_iso("date"), "_closing": tx.parse_iso("tender.tenderPeriod.endDate")}
    )
    return stage.select(
        F.coalesce("id", F.lit("")).alias("notice_id"),
        F.coalesce("tender.title", F.lit("")).alias("title"),
        F.coalesce("tender.description", F.lit("")).alias("description"),
        F.coalesce("buyer.name", F.lit("Unknown Buyer")).alias("buyer_name"),
        F.col("_published.ts").alias("published_date"),
        F.col("_closing.ts").alias("closing_date"),
        F.expr("try_cast(tender.value.amount as double)").alias("value"),
        cpv_items("tender.items").alias("cpv_codes"),
        first_region("tender.deliveryAddresses").alias("region"),
        F.col("tender.status").alias("tender_status"),
        F.col("_closing.is_naive").alias("closing_naive"),
    )


def ocds_reject_reason(as_of: Column, naive: str = "drop") -> Column:
    """Why a flat release is not taken, null if it is. A missing closing date is no reason."""
    unusable = F.lit(False) if naive != "drop" else F.coalesce(F.col("closing_naive"), F.lit(False))
    return (
        F.when(~F.col("tender_status").eqNullSafe("active"), "not active")
        .when(unusable, "closing date has no offset")
        .when(F.col("closing_date") < as_of, "closed")
        .when(F.col("published_date").isNull(), "no published date")
    )


def filter_active_ocds(flat: DataFrame, as_of: Column, naive: str = "drop") -> DataFrame:
    """Active tenders not past their closing date. A missing closing date is kept."""
    return flat.where(ocds_reject_reason(as_of, naive).isNull())


def rejected_ocds(flat: DataFrame, as_of: Column, naive: str = "drop") -> DataFrame:
    """The releases that :func:`filter_active_ocds` leaves out, with the reason."""
    reason = ocds_reject_reason(as_of, naive)
    return flat.where(reason.isNotNull()).select("notice_id", reason.alias("reason"))


def notice_points(notices: DataFrame, base: list[str] | None = None) -> DataFrame:
    """Point rows of notices: id, display text, embedding text, hoisted keys and nested metadata."""
    have = set(notices.columns)
    meta = F.struct(*[F.col(c) for c in NOTICE_COLUMNS if c in have])
    full = reduce(lambda d, c: d.withColumn(c, F.lit(None).cast("string")), {"additional_text"} - have, notices)
    full = full if "cpv_codes" in have else full.withColumn("cpv_codes", F.array().cast("array<string>"))
    return full.select(
        tx.md5_uuid("notice_id").alias("point_id"),
        F.lit("contract_opportunity").alias("document_type"),
        display.display_text().alias("content"),
        display.embedding_text().alias("embedding_text"),
        *[F.col(c) for c in HOISTED],
        meta.alias("metadata"),
        *[F.col(c) for c in base or []],
    )


def upsert(state: DataFrame, batch: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Insert or replace by key. Within the batch, the row with the highest ``order`` wins; a batch row
    always replaces the stored one. ``order`` is a batch column and is not kept.

    The stored side is neither sorted nor windowed: only the (small) batch is reduced, and the
    stored side loses the touched keys in an anti-join.
    """
    keys = [key] if isinstance(key, str) else key
    latest = latest_by(batch, keys, order).drop(order)
    untouched = state.join(latest.select(*keys), keys, "left_anti")
    return untouched.unionByName(latest, allowMissingColumns=True)


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key, as an aggregation: it combines before the
    shuffle, so a key repeated in a third of the rows does not pile up in one task. Ties are broken
    by the hash of the other columns."""
    others = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("_row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*rows.columns)


def first_by(rows: DataFrame, keys: list[str], order) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*others), tx.col(order)).alias("_row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*rows.columns)


def delete_keys(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """State without the rows whose keys are listed."""
    return state.join(gone.select(*keys), keys, "left_anti")


def clear(state: DataFrame) -> DataFrame:
    return state.limit(0)


def merge_sources(sources: list[DataFrame], key: str = "notice_id", order: str = "batch_seq") -> DataFrame:
    """All sources in one table, the latest batch winning per id."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return latest_by(united, [key], order)


def sync_stats(parsed: DataFrame, as_of: Column, naive: str = "drop", by: list[str] | None = None) -> DataFrame:
    """Rows fetched and kept, and distinct notices stored, per run."""
    kept = csv_reject_reason(as_of, naive).isNull()
    stored = F.count_distinct(F.when(kept, F.col("notice_id")))
    grouped = parsed.groupBy(*(by or []))
    return grouped.agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(kept).alias("kept"), stored.alias("stored")
    ).withColumn("status", F.when(F.col("stored") > 0, "success").otherwise("no_data"))


#: Reasons of one batch that its outcome lists; :func:`batch_reasons` has them all.
LISTED_REASONS = 20


def batch_reasons(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``(batch, reason, failed_count)``: each reason of a batch's failures as a row."""
    return results.where(F.col("reason").isNotNull()).groupBy(batch, "reason").agg(F.count(F.lit(1)).alias("failed_count"))


def batch_outcome(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Totals per batch of uploads, with its most frequent ``reasons``, ``LISTED_REASONS`` at most, in order of name.

    Reasons are free text: they are counted before they are listed, so no row grows with the failures.
    """
    failed = F.col("reason").isNotNull()
    totals = results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("failed_count")
    )
    often = Window.partitionBy(batch).orderBy(F.desc("failed_count"), "reason")
    first = batch_reasons(results, batch).withColumn("n", F.row_number().over(often)).where(F.col("n") <= LISTED_REASONS)
    listed = first.groupBy(F.col(batch).alias("_batch")).agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    none = F.array().cast("array<string>")
    return totals.join(listed, F.col(batch).eqNullSafe(F.col("_batch")), "left").drop("_batch").withColumn("reasons", F.coalesce("reasons", none))


def backfill_windows(days_back: int, as_of: Column, size: int = 30) -> list[tuple[int, int]]:
    """``(days_start, days_end)`` of each window, newest first; the last one may be short."""
    count = -(-days_back // size)
    return [(i * size, min((i + 1) * size, days_back)) for i in range(count)]


def backfill_counts(notices: DataFrame, days_back: int, as_of: Column, size: int = 30) -> DataFrame:
    """Notices per backfill window. The window number is arithmetic on the age in days, so no range join."""
    day = 86_400_000_000
    age = F.unix_micros(as_of) - F.unix_micros("published_date")
    # Windows are closed on the older side and open on the newer one.
    number = F.floor((age - 1) / F.lit(size * day)).cast("int")
    inside = (age > 0) & (age <= days_back * day)
    return (
        notices.where(inside)
        .groupBy(number.alias("window_no"))
        .agg(F.count_distinct("notice_id").alias("notices"))
        .withColumns(
            {
                "days_start": F.col("window_no") * size,
                "days_end": F.least((F.col("window_no") + 1) * size, F.lit(days_back)),
            }
        )
    )
