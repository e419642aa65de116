"""Queries over ingest: parsing, filters, notice points, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import case
from checks.views import AS_OF_SQL, Views, as_of, with_views
from noticelake.functions import display, text as tx
from noticelake.operators import ingest
from noticelake.plans import pipelines
from noticelake.session import stage_dir
from noticelake.sources import files, notices as src, pages as pg
from noticelake.sources.store import BucketTable

# ---- SQL helpers -----------------------------------------------------------------------------------

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\A{WS}+', ''), '{WS}+\z', '')"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def ts_sql(c: str) -> str:
    s = strip(c)
    return f"""CASE WHEN {s} LIKE '%Z' THEN try_strptime(replace({s}, 'Z', ''), '%Y-%m-%dT%H:%M:%S')
        WHEN {s} LIKE '%T%+%' THEN try_strptime(left({s}, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 1 HOUR
        WHEN {s} LIKE '%T%' THEN try_strptime({s}, '%Y-%m-%dT%H:%M:%S')
        ELSE coalesce(try_strptime({s}, '%d/%m/%Y'), try_strptime({s}, '%d-%m-%Y'), try_strptime({s}, '%Y-%m-%d'),
                      try_strptime({s}, '%d/%m/%Y %H:%M:%S')) END"""


def naive_sql(c: str) -> str:
    return f"coalesce({strip(c)} LIKE '%T%' AND {strip(c)} NOT LIKE '%Z' AND {strip(c)} NOT LIKE '%+%', false)"


def money_sql(c: str) -> str:
    return f"try_cast({strip(f'''translate({c}, '£,', '')''')} AS DOUBLE)"


LIST_SQL = f"list_filter(list_transform(string_split(replace(raw_cpv, ';', ','), ','), lambda x: {strip('x')}), lambda x: x <> '')"

PARSED = f"""parsed AS (
  SELECT *, coalesce(nullif({squeeze('raw_id')}, ''), 'UNKNOWN') AS notice_id, {squeeze('raw_title')} AS title,
         coalesce(nullif({squeeze('raw_buyer')}, ''), 'Unknown Buyer') AS buyer_name,
         nullif({squeeze('raw_description')}, '') AS description, {ts_sql('raw_published')} AS published_date,
         {ts_sql('raw_closing')} AS closing_date, {naive_sql('raw_closing')} AS closing_naive,
         {money_sql('raw_low')} AS value_low, {money_sql('raw_high')} AS value_high, lower({strip('raw_status')}) AS status
  FROM raw_notices),
judged AS (
  SELECT *, CASE WHEN value_low <> 0 THEN value_low ELSE value_high END AS value,
         CASE WHEN status <> 'open' THEN 'not open' WHEN closing_date IS NULL THEN 'no closing date'
              WHEN closing_naive THEN 'closing date without offset' WHEN closing_date < {AS_OF_SQL} THEN 'closed'
              WHEN published_date IS NULL THEN 'no published date' END AS reason
  FROM parsed)"""


def parsed_sql(body: str) -> str:
    return with_views("raw_notices", f"WITH {PARSED}\n{body}")


def parsed(v: Views, *keep: str):
    return ingest.parse_csv_notices(v.raw_notices, keep)


# ---- scalar parsing --------------------------------------------------------------------------------


@case("scan_notices_csv", with_views("raw_notices", "SELECT raw_id AS notice_identifier, raw_status AS status, nullif(raw_low, '') AS value_low, a4 AS postcode FROM raw_notices"))
def scan_notices_csv(v: Views):
    """The raw table through a CSV file and back, quoted line breaks included."""
    return _csv_round_trip(v).select(
        F.col("`Notice Identifier`").alias("notice_identifier"), F.col("Status").alias("status"),
        F.col("`Value Low`").alias("value_low"), F.col("`Contact Postcode`").alias("postcode"),
    )


def _csv_round_trip(v: Views):
    import uuid

    from noticelake.session import stage_dir

    path = f"{stage_dir(v.spark)}/csv-{uuid.uuid4().hex}"
    rows = v.raw_notices.select(*[f"`{c}`" for c in src.CSV_COLUMNS])
    (rows.write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return src.scan_notices_csv(v.spark, path)


@case("parse_notice_date", with_views("raw_notices", f"""
    SELECT k, raw_closing AS source, epoch({ts_sql('raw_closing')})::BIGINT AS closing, {naive_sql('raw_closing')} AS is_naive FROM raw_notices"""))
def parse_notice_date(v: Views):
    d = tx.parse_notice_date("`Closing Date`")
    return v.raw_notices.select(
        "k", F.col("`Closing Date`").alias("source"), F.unix_seconds(d["ts"]).alias("closing"), d["is_naive"].alias("is_naive")
    )


@case("parse_money", with_views("raw_notices", f"SELECT k, {money_sql('raw_low')} AS low, {money_sql('raw_high')} AS high FROM raw_notices"))
def parse_money(v: Views):
    return v.raw_notices.select("k", tx.parse_money("`Value Low`").alias("low"), tx.parse_money("`Value High`").alias("high"))


@case("clean_field", with_views("raw_notices", f"""
    SELECT k, nullif({squeeze('raw_title')}, '') AS title, nullif({squeeze('raw_description')}, '') AS description,
           nullif({squeeze('raw_id')}, '') AS ident FROM raw_notices"""))
def clean_field(v: Views):
    return v.raw_notices.select(
        "k", tx.clean_field("Title").alias("title"), tx.clean_field("Description").alias("description"),
        tx.clean_field("`Notice Identifier`").alias("ident"),
    )


@case("parse_cpv", with_views("raw_notices", f"SELECT k, array_to_string({LIST_SQL}, '|') AS codes FROM raw_notices"))
def parse_cpv(v: Views):
    return v.raw_notices.select("k", F.array_join(tx.parse_list("`Cpv Codes`"), "|").alias("codes"))


@case("parse_bool", with_views("raw_notices", f"""
    SELECT k, CASE WHEN lower({strip('raw_sme')}) IN ('yes','true','1','y') THEN true
                   WHEN lower({strip('raw_sme')}) IN ('no','false','0','n') THEN false END AS sme FROM raw_notices"""))
def parse_bool(v: Views):
    return v.raw_notices.select("k", tx.parse_bool("`Suitable for SME`").alias("sme"))


@case("join_address", with_views("raw_notices", f"""
    SELECT k, nullif(array_to_string(list_filter([{strip('a1')}, {strip('a2')}, {strip('a3')}, {strip('a4')}],
           lambda x: x IS NOT NULL AND x <> ''), ', '), '') AS address FROM raw_notices"""))
def join_address(v: Views):
    return v.raw_notices.select("k", tx.join_parts(*[
        f"`{c}`" for c in ("Contact Address 1", "Contact Address 2", "Contact Town", "Contact Postcode", "Contact Country")
    ]).alias("address"))


@case("pick_value", parsed_sql("SELECT k, value FROM judged"))
def pick_value(v: Views):
    return parsed(v, "k").select("k", "value")


@case("notice_defaults", parsed_sql("SELECT k, notice_id, title, buyer_name FROM judged"))
def notice_defaults(v: Views):
    return parsed(v, "k").select("k", "notice_id", "title", "buyer_name")


@case("filter_open_csv", parsed_sql("SELECT k, notice_id, epoch(closing_date)::BIGINT AS closing, value FROM judged WHERE reason IS NULL"))
def filter_open_csv(v: Views):
    return ingest.filter_open_csv(parsed(v, "k"), as_of()).select("k", "notice_id", F.unix_seconds("closing_date").alias("closing"), "value")


# ---- release packages ------------------------------------------------------------------------------

RELEASES = f"""rel AS (
  SELECT notice_id AS id, title, description, buyer_name, value, region, k, published_date, closing_date, notice_type,
         CASE WHEN k % 7 = 0 THEN NULL ELSE closing_date END AS closing, k % 5 = 1 AS naive,
         CASE WHEN status = 'open' THEN 'active' ELSE 'complete' END AS tender_status
  FROM notices)"""


def packages(v: Views):
    """Release packages as JSON text, one package per day of publication."""
    k = F.substring("notice_id", 3, 20).cast("long")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    end = F.when(k % 7 == 0, None).otherwise(F.concat(stamp("closing_date"), F.when(k % 5 == 1, "").otherwise("Z")))
    item = lambda scheme, code: F.struct(F.struct(F.lit(scheme).alias("scheme"), code.alias("id")).alias("classification"))
    tender = F.struct(
        "title", F.col("description"), F.when(F.col("status") == "open", "active").otherwise("complete").alias("status"),
        F.struct(end.alias("endDate")).alias("tenderPeriod"), F.struct(F.col("value").alias("amount")).alias("value"),
        F.array(item("CPV", F.col("notice_type")), item("OTHER", F.col("region")), item("CPV", F.col("region"))).alias("items"),
        F.when(k % 3 == 0, F.array().cast("array<struct<region:string>>")).otherwise(F.array(F.struct("region"))).alias("deliveryAddresses"),
    )
    buyer = F.when(k % 11 == 0, None).otherwise(F.struct(F.col("buyer_name").alias("name")))
    release = F.struct(
        F.col("notice_id").alias("id"), F.concat(stamp("published_date"), F.lit("Z")).alias("date"), buyer.alias("buyer"), tender.alias("tender")
    )
    # One release per document, half of them bare, so that packages stay of bounded size.
    one = F.to_json(release)
    return v.notices.select(F.when(k % 2 == 0, F.concat(F.lit('{"releases":['), one, F.lit("]}"))).otherwise(one).alias("body"))


def flat(v: Views):
    return ingest.flatten_ocds(src.parse_packages(packages(v)))


@case("scan_ocds_json", with_views("notices", f"WITH {RELEASES} SELECT id, tender_status AS status FROM rel"))
def scan_ocds_json(v: Views):
    """Packages written as files and read back as releases."""
    import uuid

    from noticelake.session import stage_dir

    path = f"{stage_dir(v.spark)}/ocds-{uuid.uuid4().hex}"
    packages(v).select(F.col("body").alias("value")).write.option("compression", "gzip").text(path)
    return src.scan_ocds_json(v.spark, path, one_per_line=True).select("id", F.col("tender.status").alias("status"))


@case("flatten_ocds", with_views("notices", f"""WITH {RELEASES}
    SELECT id AS notice_id, title, description, CASE WHEN k % 11 = 0 THEN 'Unknown Buyer' ELSE buyer_name END AS buyer_name,
           epoch(published_date)::BIGINT AS published, epoch(closing)::BIGINT AS closing, value FROM rel"""))
def flatten_ocds(v: Views):
    return flat(v).select(
        "notice_id", "title", "description", "buyer_name", F.unix_seconds("published_date").alias("published"),
        F.unix_seconds("closing_date").alias("closing"), "value",
    )


@case("extract_cpv_items", with_views("notices", f"WITH {RELEASES} SELECT id AS notice_id, notice_type || '|' || region AS codes FROM rel"))
def extract_cpv_items(v: Views):
    return flat(v).select("notice_id", F.array_join("cpv_codes", "|").alias("codes"))


@case("first_region", with_views("notices", f"WITH {RELEASES} SELECT id AS notice_id, CASE WHEN k % 3 <> 0 THEN region END AS region FROM rel"))
def first_region(v: Views):
    return flat(v).select("notice_id", "region")


@case("filter_active_ocds", with_views("notices", f"""WITH {RELEASES}
    SELECT id AS notice_id, epoch(closing)::BIGINT AS closing FROM rel
    WHERE tender_status = 'active' AND (closing IS NULL OR (closing >= {AS_OF_SQL} AND NOT naive))"""))
def filter_active_ocds(v: Views):
    return ingest.filter_active_ocds(flat(v), as_of()).select("notice_id", F.unix_seconds("closing_date").alias("closing"))


@case("ocds_rejects", with_views("notices", f"""WITH {RELEASES} SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN tender_status IS DISTINCT FROM 'active' THEN 'not active' WHEN closing IS NOT NULL AND naive THEN 'closing date has no offset'
                WHEN closing < {AS_OF_SQL} THEN 'closed' END AS reason FROM rel) WHERE reason IS NOT NULL GROUP BY 1"""))
def ocds_rejects(v: Views):
    return ingest.rejected_ocds(flat(v), as_of()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@case("concat_pages", with_views("notices", f"WITH {RELEASES} SELECT tender_status, count(*) AS releases FROM rel GROUP BY 1"))
def concat_pages(v: Views):
    """Release pages in many files of two folders, read as one table."""
    import uuid

    from noticelake.session import stage_dir

    path = f"{stage_dir(v.spark)}/release-pages-{uuid.uuid4().hex}"
    body = packages(v).select(F.col("body").alias("value"))
    # A write for each folder: one write of both would sort the pages by folder first.
    for half in (0, 1):
        some = body.where(F.crc32("value") % 2 == half)
        some.write.option("maxRecordsPerFile", 1000).option("compression", "gzip").text(f"{path}/half={half}")
    read = ingest.flatten_ocds(src.scan_ocds_json(v.spark, f"{path}/half=*", one_per_line=True))
    return read.groupBy("tender_status").agg(F.count(F.lit(1)).alias("releases"))


# ---- points ----------------------------------------------------------------------------------------


@case("notice_point_id", with_views("notices", "SELECT notice_id, md5(notice_id)::UUID::VARCHAR AS point_id FROM notices"))
def notice_point_id(v: Views):
    return v.notices.select("notice_id", tx.md5_uuid("notice_id").alias("point_id"))


DISPLAY_SQL = f"""{strip('''concat_ws(chr(10), 'Title: ' || title, 'Description: ' || coalesce(nullif(description, ''), 'No description'),
    'Buyer: ' || buyer_name, 'Value: £' || format('{:,.2f}', value), 'CPV Codes: ' || codes, 'Region: ' || region,
    'Closing Date: ' || strftime(closing_date, '%Y-%m-%d'), 'Additional Info: None')''')}"""


def with_codes(v: Views):
    return v.notices.withColumn("cpv_codes", F.when(F.col("status") == "open", F.array("notice_type", "region")).otherwise(F.array().cast("array<string>")))


CODES_SQL = "WITH coded AS (SELECT *, CASE WHEN status = 'open' THEN notice_type || ', ' || region ELSE 'None' END AS codes FROM notices) "


@case("notice_display_text", with_views("notices", f"{CODES_SQL} SELECT notice_id, {DISPLAY_SQL} AS content FROM coded"))
def notice_display_text(v: Views):
    rows = with_codes(v).withColumn("additional_text", F.lit(None).cast("string"))
    return rows.select("notice_id", display.display_text().alias("content"))


EMBED_SQL = rf"""left(regexp_replace({strip("title || chr(10) || chr(10) || coalesce(description, '')")}, '\r\n|\r|\n', ' ', 'g'), 2000)"""


@case("notice_embedding_text", with_views("notices", f"SELECT notice_id, {EMBED_SQL} AS embedding_text FROM notices"))
def notice_embedding_text(v: Views):
    return v.notices.select("notice_id", display.embedding_text().alias("embedding_text"))


@case("notice_payload", with_views("notices", f"""{CODES_SQL}
    SELECT md5(notice_id)::UUID::VARCHAR AS point_id, 'contract_opportunity' AS document_type, {DISPLAY_SQL} AS content, notice_id, buyer_name,
           value, region, title AS m_title, strftime(closing_date, '%Y-%m-%d %H:%M') AS m_closing, notice_type AS m_notice_type,
           replace(replace(codes, 'None', ''), ', ', '|') AS m_codes FROM coded"""))
def notice_payload(v: Views):
    p = ingest.notice_points(with_codes(v))
    return p.select(
        "point_id", "document_type", "content", "notice_id", "buyer_name", "value", "region",
        F.col("metadata.title").alias("m_title"), F.date_format("metadata.closing_date", "yyyy-MM-dd HH:mm").alias("m_closing"),
        F.col("metadata.notice_type").alias("m_notice_type"), F.array_join("metadata.cpv_codes", "|").alias("m_codes"),
    )


# ---- state of notices ------------------------------------------------------------------------------


@case("upsert_points", with_views("notices", """
    SELECT notice_id, CASE WHEN status = 'open' THEN value * 2 ELSE value END AS value,
           CASE WHEN status = 'open' THEN notice_type ELSE status END AS tag FROM notices"""))
def upsert_points(v: Views):
    """Open notices arrive again twice, the later copy with another value, in a table changed in place and read back."""
    stored = v.notices.select("notice_id", "value", F.col("status").alias("tag"), F.lit(0).alias("batch_seq"))
    again = v.notices.where("status = 'open'").select("notice_id", "value", F.col("notice_type").alias("tag"))
    batch = again.withColumn("batch_seq", F.lit(1)).unionByName(
        again.withColumns({"value": F.col("value") * 2, "batch_seq": F.lit(2)})
    )
    table = BucketTable(v.spark, f"{stage_dir(v.spark)}/notices-{uuid.uuid4().hex}", stored.schema, ["notice_id"], "batch_seq", buckets=16)
    table.upsert(stored)
    table.upsert(batch)
    return table.read().drop("batch_seq")


@case("delete_points", with_views("points", """
    SELECT point_id, document_type FROM points p WHERE NOT EXISTS (
        SELECT 1 FROM points d WHERE d.m_title = 'en' AND d.document_type = 'legal_document' AND d.document_id = p.document_id AND d.firm_id = p.firm_id)"""))
def delete_points(v: Views):
    """Documents are deleted by document and firm from a table changed in place, and the table is read back."""
    p = v.points.select("point_id", "document_type", "document_id", "firm_id", F.col("metadata.title").alias("lang"), F.lit(0).alias("batch_seq"))
    table = BucketTable(v.spark, f"{stage_dir(v.spark)}/points-{uuid.uuid4().hex}", p.schema, ["point_id"], "batch_seq", buckets=16)
    table.upsert(p)
    gone = table.read().where("document_type = 'legal_document' AND lang = 'en'").select("document_id", "firm_id").distinct()
    table.delete(table.read().join(gone, ["document_id", "firm_id"], "left_semi"))
    return table.read().select("point_id", "document_type")


@case("merge_sources", with_views("raw_notices", f"""WITH {PARSED}
    SELECT coalesce(n.notice_id, c.notice_id) AS notice_id,
           CASE WHEN n.notice_id IS NOT NULL THEN 'ocds' ELSE 'csv' END AS source, coalesce(n.value, c.value) AS value
    FROM (SELECT notice_id, max_by(value, k) AS value FROM judged WHERE reason IS NULL GROUP BY 1) c
    FULL JOIN (SELECT notice_id, value FROM notices WHERE status = 'open' AND (k % 7 = 0 OR (closing_date >= {AS_OF_SQL} AND k % 5 <> 1))) n USING (notice_id)"""))
def merge_sources(v: Views):
    csv = ingest.filter_open_csv(parsed(v, "k"), as_of()).select("notice_id", "value", F.lit("csv").alias("source"), F.col("k").alias("batch_seq"))
    ocds = ingest.filter_active_ocds(flat(v), as_of()).select(
        "notice_id", "value", F.lit("ocds").alias("source"), F.lit(10**15).cast("long").alias("batch_seq")
    )
    return ingest.merge_sources([csv, ocds]).select("notice_id", "source", "value")


@case("sync_stats", parsed_sql("""
    SELECT raw_region AS run, count(*) AS fetched, count(*) FILTER (reason IS NULL) AS kept,
           count(DISTINCT CASE WHEN reason IS NULL THEN notice_id END) AS stored,
           CASE WHEN count(DISTINCT CASE WHEN reason IS NULL THEN notice_id END) > 0 THEN 'success' ELSE 'no_data' END AS status
    FROM judged GROUP BY 1"""))
def sync_stats(v: Views):
    return ingest.sync_stats(parsed(v), as_of(), by=["region"]).withColumnRenamed("region", "run")


@case("csv_sync", parsed_sql("SELECT notice_id, max_by(value, k) AS value, max_by(buyer_name, k) AS buyer_name FROM judged WHERE reason IS NULL GROUP BY 1"))
def csv_sync(v: Views):
    empty = parsed(v).drop("status", "closing_naive").limit(0)
    return pipelines.csv_sync(v.raw_notices, empty, as_of(), "k").select("notice_id", "value", "buyer_name")


@case("csv_rejects", parsed_sql("SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1"))
def csv_rejects(v: Views):
    return ingest.rejected_csv(parsed(v), as_of()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@case("backfill_windows", with_views("notices", f"""
    SELECT w.i AS window_no, w.i * 30 AS days_start, least((w.i + 1) * 30, 365) AS days_end, count(DISTINCT notice_id) AS notices
    FROM range(13) w(i) JOIN notices ON published_date >= {AS_OF_SQL} - to_days(least((w.i + 1) * 30, 365)::INT)
         AND published_date < {AS_OF_SQL} - to_days((w.i * 30)::INT)
    GROUP BY w.i"""))
def backfill_windows(v: Views):
    return ingest.backfill_counts(v.notices, 365, as_of()).withColumn("window_no", F.col("window_no").cast("long"))


@case("batch_outcome", """
    SELECT source AS batch_id, count(*) AS total_files, count(*) FILTER (n_chars >= 500) AS success_count,
           count(*) FILTER (n_chars < 500) AS failed_count, CASE WHEN count(*) FILTER (n_chars < 500) > 0 THEN 'too short' ELSE '' END AS reasons
    FROM documents GROUP BY 1""")
def batch_outcome(v: Views):
    results = v.table("documents").select(F.col("source").alias("batch_id"), F.when(F.col("n_chars") < 500, "too short").alias("reason"))
    return ingest.batch_outcome(results).withColumn("reasons", F.array_join("reasons", "|"))


# ---- files -----------------------------------------------------------------------------------------


@case("scan_uploads", """
    SELECT lang, 'txt' AS file_type, NULL AS reject_reason, sum(length(coalesce(text, '')) + 1)::BIGINT AS n_chars FROM documents GROUP BY 1
    UNION ALL SELECT DISTINCT lang, 'json', 'unsupported type', 0 FROM documents""")
def scan_uploads(v: Views):
    """Whole texts written as text files (a line feed after each) and listed beside JSON files, which are no upload type."""
    import uuid

    from noticelake.session import stage_dir

    root = f"{stage_dir(v.spark)}/uploads-{uuid.uuid4().hex}"
    docs = v.table("documents").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 20).text(f"{root}/texts")
    docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).write.partitionBy("lang").json(f"{root}/rows")
    read = files.scan_uploads(v.spark, root)
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")
    return read.groupBy(lang, "file_type", "reject_reason").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))


@case("screen_uploads", """
    SELECT source || '.' || lang AS name, lower(lang) AS file_type,
           CASE WHEN lower(lang) NOT IN ('pdf','docx','doc','txt') THEN 'unsupported type' WHEN n_chars * 1000 > 10485760 THEN 'too large' END AS reject_reason,
           count(*) AS n
    FROM (SELECT source, n_chars, CASE lang WHEN 'en' THEN 'TXT' WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'docx' ELSE 'exe' END AS lang FROM documents)
    GROUP BY ALL""")
def screen_uploads(v: Views):
    """The acceptance rule over listed files (path and length)."""
    kind = F.when(F.col("lang") == "en", "TXT").when(F.col("lang") == "fr", "pdf").when(F.col("lang") == "de", "docx").otherwise("exe")
    listed = v.table("documents").select(F.concat_ws(".", "source", kind).alias("path"), (F.col("n_chars") * 1000).alias("length"))
    return files.screen_uploads(listed).groupBy(F.col("path").alias("name"), "file_type", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@case("sink_by_date", "SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, count(*) AS n FROM events GROUP BY 1")
def sink_by_date(v: Views):
    """Rows written below one folder per day, counted from the folders."""
    import uuid

    from noticelake.session import stage_dir

    path = f"{stage_dir(v.spark)}/by-date-{uuid.uuid4().hex}"
    rows = v.table("events").select(F.col("event_id").cast("string").alias("document_id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("ingest_date"))
    files.sink_by_date(rows, path)
    back = v.spark.read.schema("document_id string, event_type string, ingest_date string").parquet(path)
    return back.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"))


# ---- pages -----------------------------------------------------------------------------------------


def text_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return strip(bare)


@case("scan_notice_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def scan_notice_pages(v: Views):
    return v.table("pages").select("page_id", "url", F.length("html").alias("html_chars"))


@case("html_notice_fields", rf"""
    SELECT page_id, {text_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
           array_to_string(list_transform(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), lambda x: {text_sql('x')}), '|') AS items,
           {text_sql("regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1)")} AS first_paragraph
    FROM pages""")
def html_notice_fields(v: Views):
    """The field extractors with the patterns of the shared pages, whose markup has its own shape."""
    return v.table("pages").select(
        "page_id", pg.first_match("html", r"(?s)<h1[^>]*>(.*?)</h1>", "").alias("title"),
        F.array_join(pg.all_matches("html", r"(?s)<li[^>]*>(.*?)</li>"), "|").alias("items"),
        pg.first_match("html", r"(?s)<p[^>]*>(.*?)</p>", "").alias("first_paragraph"),
    )


@case("tender_id_from_url", """
    SELECT page_id, split_part(list_extract(string_split(replace(url, '/en/', '/Notice/'), '/Notice/'), -1), '?', 1) AS tender_id FROM pages""")
def tender_id_from_url(v: Views):
    return v.table("pages").select("page_id", tx.tender_id(F.replace("url", F.lit("/en/"), F.lit("/Notice/"))).alias("tender_id"))


LINKS = """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS link FROM pages"""


@case("page_links", LINKS)
def page_links(v: Views):
    return pg.page_links(v.table("pages"), "/[^\"]*")


@case("dedupe_links", f"SELECT DISTINCT link FROM ({LINKS})")
def dedupe_links(v: Views):
    return pg.distinct_links(page_links(v))


@case("unseen_urls", f"""
    SELECT DISTINCT link AS url FROM ({LINKS}) WHERE link NOT IN (SELECT link FROM ({LINKS}) JOIN pages USING (page_id) WHERE url LIKE 'https:%')""")
def unseen_urls(v: Views):
    links = page_links(v)
    known = links.join(v.table("pages").where(F.col("url").startswith("https:")).select("page_id"), "page_id")
    return pg.unseen_urls(links.select(F.col("link").alias("url")).distinct(), known.select(F.col("link").alias("url")))


@case("sink_json_append", f"SELECT DISTINCT link AS url FROM ({LINKS})")
def sink_json_append(v: Views):
    """Links of https pages are stored first, then only the unseen rest is appended."""
    import uuid

    from noticelake.session import stage_dir

    path = f"{stage_dir(v.spark)}/links-{uuid.uuid4().hex}"
    links = page_links(v).join(v.table("pages").select("page_id", F.col("url").startswith("https:").alias("first")), "page_id")
    url = F.col("link").alias("url")
    files.sink_json_append(links.where("first").select(url).distinct(), path)
    stored = v.spark.read.schema("url string").json(path)
    files.sink_json_append(pg.unseen_urls(links.where("NOT first").select(url).distinct(), stored), path)
    return v.spark.read.schema("url string").json(path)
