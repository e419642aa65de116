"""Queries that run whole pipelines and operators over all of their tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.cases_ingest import PARSED, RELEASES, packages, squeeze
from checks.cases_scoring import SCORES, SCORES_SQL, query, scored_sql
from checks.cases_vectors import topk_sql
from checks.registry import case
from checks.views import AS_OF_SQL, Views, as_of, with_views
from noticelake.operators import ingest, quality, vectors
from noticelake.plans import pipelines
from noticelake.session import stage_dir, staged
from noticelake.sources import notices as src, pages as pg, tables
from noticelake.sources.store import BucketTable


def folder(v: Views, name: str) -> str:
    return f"{stage_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def hash_vectors_sql(rows: str, key: str, text: str, name: str) -> str:
    """CTEs ending in ``name``: the hash provider's vector of each text, as ``(key, embedding)``."""
    return f"""{name}_slots AS (
    SELECT k, ('0x' || left(h, 6))::INT % 64 AS slot, sum(CASE WHEN h[32] < '8' THEN 1 ELSE -1 END)::DOUBLE AS n
    FROM (SELECT k, md5(u) AS h FROM (SELECT {key} AS k, unnest(string_split({squeeze(f'lower({text})')}, ' ')) AS u FROM {rows}) WHERE u <> '') GROUP BY 1, 2),
  {name} AS (
    SELECT k AS {key}, list_transform(range(64), lambda i: (CASE WHEN l = 0 THEN 0 ELSE coalesce(m[i][1], 0) / l END)::FLOAT::DOUBLE) AS embedding
    FROM (SELECT k, map(list(slot::BIGINT), list([n])) AS m, sqrt(sum(n * n)) AS l FROM {name}_slots GROUP BY 1))"""


# ---- providers and indexes ------------------------------------------------------------------------


def letter_counts():
    """A model that is cheap to check: lengths, words and spaces; it fails on some texts."""
    def model(texts: pd.Series):
        if (texts.str.len() % 10 == 0).any():
            raise ValueError("length")
        return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]

    return model


MODEL_SQL = """made AS (
    SELECT doc_id, CASE WHEN length(text) % 10 <> 0 THEN [length(text), length(text) - length(replace(text, ' ', '')), length(text) - length(replace(text, 'e', ''))]::DOUBLE[] END AS embedding
    FROM documents)"""


@case("embed_model", f"WITH {MODEL_SQL} SELECT doc_id, embedding[1] AS chars, embedding[2] AS spaces, embedding[3] AS letters, embedding IS NULL AS failed FROM made")
def embed_model(v: Views):
    made = vectors.embed_model(v.table("documents"), "doc_id", "text", letter_counts)
    at = lambda k: F.col("embedding")[k].cast("double")
    return made.select("doc_id", at(0).alias("chars"), at(1).alias("spaces"), at(2).alias("letters"), F.col("error").isNotNull().alias("failed"))


@case("embed_outcome", f"WITH {MODEL_SQL} SELECT count(*) AS total, count(embedding) AS success_count, count(*) - count(embedding) AS failed_count FROM made")
def embed_outcome(v: Views):
    return vectors.embed_outcome(vectors.embed_model(v.table("documents"), "doc_id", "text", letter_counts))


FIRST = "round(embedding[1], 5) AS x0, round(embedding[33], 5) AS x32, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) AS norm2"


def first(df: DataFrame, *keep: str) -> DataFrame:
    x = lambda k: F.round(F.col("embedding")[k].cast("double"), 5)
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return df.select(*keep, x(0).alias("x0"), x(32).alias("x32"), F.round(norm2, 4).alias("norm2"))


NOTICE_TEXT = r"left(regexp_replace(trim(regexp_replace(title || chr(10) || chr(10) || coalesce(description, ''), '^\s+|\s+$', '', 'g')), '\r\n|\r|\n', ' ', 'g'), 2000)"


@case("index_notices", with_views("notices", f"""WITH texts AS (SELECT notice_id, {NOTICE_TEXT} AS t FROM notices),
  {hash_vectors_sql('texts', 'notice_id', 't', 'made')}
  SELECT md5(notice_id)::UUID::VARCHAR AS point_id, notice_id, {FIRST} FROM made"""))
def index_notices(v: Views):
    return first(pipelines.index_notices(v.notices, vectors.embed_hash), "point_id", "notice_id")


@case("index_chunks", with_views("ns", f"""WITH words AS (SELECT doc_id, list_filter(string_split({squeeze('text')}, ' '), lambda w: w <> '') AS w, {squeeze('text')} AS clean FROM documents),
  win AS (SELECT doc_id, clean, s.i, array_to_string(w[(s.i * 800 + 1):(s.i * 800 + 1000)], ' ') AS chunk_text
          FROM words, LATERAL (SELECT unnest(range(0, ((len(w) + 799) // 800)::BIGINT)) AS i) s WHERE len(w) > 0),
  kept AS (SELECT DISTINCT 'user_' || (doc_id % (SELECT n FROM ns)) || '_doc_' || left(md5(clean), 12) || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS chunk_id, chunk_text
           FROM win WHERE length(chunk_text) > 100),
  {hash_vectors_sql('kept', 'chunk_id', 'chunk_text', 'made')}
  SELECT chunk_id, {FIRST} FROM made"""))
def index_chunks(v: Views):
    """Texts uploaded twice by one user make one document: its chunks replace each other."""
    ns = v.size("supplier")
    docs = v.table("documents").select((F.col("doc_id") % ns).alias("user_id"), "text").distinct()
    return first(pipelines.index_documents(docs, vectors.embed_hash).dropDuplicates(["chunk_id"]), "chunk_id")


@case("recommend_from_texts", query(f"""texts AS (SELECT notice_id, {NOTICE_TEXT} AS t FROM notices),
  asked AS (SELECT firm_id, string_agg(capability_text, ' ' ORDER BY n) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY capability_id) AS n FROM capabilities) WHERE n <= 3 GROUP BY 1),
  {hash_vectors_sql('texts', 'notice_id', 't', 'notices_made')},
  {hash_vectors_sql('asked', 'firm_id', 't', 'queries_made')},
  {hash_vectors_sql('capabilities', 'capability_id', 'capability_text', 'skills_made')},
  skills AS (SELECT capability_id, c.firm_id, m.embedding FROM capabilities c JOIN skills_made m USING (capability_id)),
  {topk_sql('SELECT firm_id AS query_id, embedding FROM queries_made', "SELECT md5(notice_id)::UUID::VARCHAR AS point_id, notice_id, embedding FROM notices_made", 10)},
  {scored_sql('SELECT query_id AS firm_id, notice_id FROM hits').replace('notice_vectors v', 'notices_made v').replace('capabilities c', 'skills c').replace('asked', 'wanted')},
  ranked AS (SELECT s.*, h.score, row_number() OVER (PARTITION BY s.firm_id ORDER BY round(total_score, 9) DESC, h.score DESC, s.notice_id) AS place
             FROM scored s JOIN hits h ON h.query_id = s.firm_id AND h.notice_id = s.notice_id)
  SELECT firm_id, notice_id, round(score, 5) AS score, {SCORES_SQL.replace('6)', '5)')}, place::INT AS place FROM ranked WHERE place <= 5"""))
def recommend_from_texts(v: Views):
    """Capability texts to a query, the query to a vector, and on to ranked notices, all by one provider."""
    points = pipelines.index_notices(v.notices, vectors.embed_hash).where("embedding IS NOT NULL")
    # Search reads no texts of the points, so none are written.
    made = staged(points.select("point_id", "document_type", "notice_id", "embedding"), "hashed-points")
    skills = v.capability_rows.join(vectors.embed_hash(v.capability_rows, "capability_id", "capability_text"), "capability_id", "left")
    t = v.scoring_tables | {"notice_vectors": made.select("notice_id", "embedding"), "capabilities": skills}
    best = pipelines.recommend_from_texts(v.capability_rows, made, vectors.embed_hash, 5, t)
    return best.select("firm_id", "notice_id", *[F.round(c, 5).alias(c) for c in ("score", *SCORES)], "place")


@case("batch_reasons", """
    SELECT source AS batch_id, CASE WHEN n_chars < 100 THEN 'very short' ELSE 'short in ' || lang END AS reason, count(*) AS failed_count
    FROM documents WHERE n_chars < 500 GROUP BY 1, 2""")
def batch_reasons(v: Views):
    why = F.when(F.col("n_chars") < 100, "very short").when(F.col("n_chars") < 500, F.concat(F.lit("short in "), "lang"))
    return ingest.batch_reasons(v.table("documents").select(F.col("source").alias("batch_id"), why.alias("reason")))


# ---- syncs ----------------------------------------------------------------------------------------


@case("sync_run", with_views("raw_notices", f"""WITH {PARSED}
    SELECT count(*) AS fetched, count(*) FILTER (reason IS NULL) AS kept, count(DISTINCT CASE WHEN reason IS NULL THEN notice_id END) AS stored, 'success' AS status FROM judged"""))
def sync_run(v: Views):
    """A sync into a table changed in place, with the numbers observed in it; what was stored is counted again."""
    raw = v.raw_notices.withColumn("seq", F.col("k"))
    shape = ingest.parse_csv_notices(raw, ("seq",)).drop("status", "closing_naive").schema
    table = BucketTable(v.spark, folder(v, "sync"), shape, ["notice_id"], "seq", buckets=16)
    run = pipelines.observed_sync(raw, table, as_of())
    seen = table.read().agg(F.count(F.lit(1)).alias("stored"))
    return seen.select(
        F.lit(run["fetched"]).cast("long").alias("fetched"), F.lit(run["kept"]).cast("long").alias("kept"),
        F.when(F.col("stored") == run["stored"], F.col("stored")).alias("stored"), F.lit(run["status"]).alias("status"),
    )


@case("ocds_sync", with_views("notices", f"""WITH {RELEASES},
  fresh AS (SELECT notice_id, value, 'Leeds' AS was FROM notices WHERE status = 'open' AND (k % 7 = 0 OR (closing_date >= {AS_OF_SQL} AND k % 5 <> 1)))
  SELECT notice_id, value, true AS fresh FROM fresh
  UNION ALL SELECT notice_id, -1.0, false FROM notices WHERE k % 3 = 0 AND notice_id NOT IN (SELECT notice_id FROM fresh)"""))
def ocds_sync(v: Views):
    """Written release files are read, filtered and put into the stored notices; older rows of other ids stay."""
    path = folder(v, "releases")
    packages(v).select(F.col("body").alias("value")).write.option("compression", "gzip").text(path)
    found = src.scan_ocds_json(v.spark, path, one_per_line=True)
    stored = v.notices.where("cast(substring(notice_id, 3) as long) % 3 = 0").select("notice_id", F.lit(-1.0).alias("value"))
    after = pipelines.ocds_sync(found, stored, as_of())
    return after.select("notice_id", "value", F.col("published_date").isNotNull().alias("fresh"))


@case("notice_records", with_views("notices", """
    SELECT 'https://x.example/Notice/' || k || '?origin=a' AS url, k::VARCHAR AS tender_id, CASE WHEN k % 11 = 0 THEN 'Untitled' ELSE title END AS title,
           CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE buyer_name END AS publishing_authority, notice_id, strftime(published_date, '%d %B %Y') AS published_date,
           CASE WHEN k % 4 = 0 THEN '' ELSE notice_type END AS reference, CASE WHEN k % 3 = 0 THEN 'Unknown' ELSE strftime(closing_date, '%Y-%m-%d') END AS award_decision_date,
           CASE WHEN k % 2 = 0 THEN '£' || format('{:,.2f}', value) || '|inc. VAT' ELSE '' END AS contract_value, region AS supplier_name,
           region || ' Street|AB1' AS supplier_address, CASE WHEN k % 7 = 0 THEN 'Unknown' ELSE 'a' || k || '@x.example' END AS supplier_email,
           buyer_name AS authority_name, 'Unknown' AS authority_address, 'http://b.example/' || k AS authority_website
    FROM notices"""))
def notice_records(v: Views):
    """Every notice rendered as a page with its labels, some left out, and read back as a record."""
    n = v.notices.withColumn("k", F.substring("notice_id", 3, 20).cast("long"))
    k, text = F.col("k"), lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    says = lambda label, c, off=0: F.when(k % off != 0, F.concat(F.lit(f"<h3>{label}</h3>\n<p> "), text(c), F.lit("</p>"))).otherwise("") if off else F.concat(F.lit(f"<h3>{label}</h3><div>"), text(c), F.lit("</div>"))
    html = F.concat(
        F.when(k % 11 != 0, F.concat(F.lit('<h1 class="big govuk-heading-l">'), text(F.col("title")), F.lit("</h1>"))).otherwise(""),
        F.when(k % 5 != 0, F.concat(F.lit('<div class="govuk-grid-column-three-quarters"><ul class="govuk-list"><li>'), text(F.col("buyer_name")), F.lit("</li><li>x</li></ul></div>"))).otherwise(""),
        says("Notice identifier:", F.col("notice_id")), says("Published", F.date_format("published_date", "dd MMMM yyyy")),
        says("Reference", F.col("notice_type"), 4), says("Award decision date", F.date_format("closing_date", "yyyy-MM-dd"), 3),
        F.when(k % 2 == 0, F.concat(F.lit("<h3>Contract value</h3><ul><li>£"), F.format_number("value", 2), F.lit(" </li><li>inc. VAT</li></ul>"))).otherwise(""),
        F.lit('<h3 id="supplier_or_tenderer_0">'), F.col("region"), F.lit('</h3><div class="govuk-body"><p>'), F.col("region"), F.lit(" Street</p><p>AB1</p>"),
        F.when(k % 7 != 0, F.concat(F.lit('<a href="mailto:a'), k.cast("string"), F.lit('@x.example">m</a>'))).otherwise(""), F.lit("</div>"),
        F.lit('<h3 id="contracting_authority_0">'), F.col("buyer_name"), F.lit('</h3><div class="govuk-body"><a href="http://b.example/'), k.cast("string"), F.lit('">w</a></div>'),
    )
    rendered = n.select(F.concat(F.lit("https://x.example/Notice/"), k.cast("string"), F.lit("?origin=a")).alias("url"), html.alias("html"))
    lists = ("contract_value", "supplier_address", "authority_address")
    return pg.notice_fields(rendered).withColumns({c: F.array_join(c, "|") for c in lists}).select(
        "url", "tender_id", "title", "publishing_authority", "notice_id", "published_date", "reference", "award_decision_date", "contract_value",
        "supplier_name", "supplier_address", "supplier_email", "authority_name", "authority_address", "authority_website",
    )


# ---- tables and rules -----------------------------------------------------------------------------


def relational(v: Views) -> dict[str, DataFrame]:
    """Rows of the nine tables, with the columns the views can fill."""
    num = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    return {
        "users": v.users.select(F.col("user_id").cast("string").alias("id"), "email", "full_name", "firm_id", "is_active", "email_notifications_enabled", "notification_frequency", "last_email_sent_at"),
        "audit_logs": v.requests_log.select(F.col("event_id").alias("id"), "user_id", F.col("method").alias("action"), F.col("path").alias("resource_type"),
                                            F.create_map(F.lit("status"), F.col("status_code").cast("string")).alias("details"), F.col("ts").alias("timestamp")),
        "conversations": v.conversations.select(F.col("conversation_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "firm_id", "updated_at"),
        "messages": v.messages.select(F.col("message_id").alias("id"), F.col("conversation_id").cast("string").alias("conversation_id"), "role", "content", "timestamp"),
        "company_profiles": v.firms.select(F.col("company_id").alias("id"), "firm_id", "company_name", (F.col("company_id") % 3).cast("int").alias("onboarding_completed")),
        "company_capabilities": v.capability_rows.select(F.col("capability_id").alias("id"), num("firm_id").alias("company_id"), "capability_text", "category"),
        "past_wins": v.past_wins.select(num("firm_id").alias("company_id"), "buyer_name", "contract_value", "award_date", F.col("win_id").alias("description")),
        "search_preferences": v.preferences.select(num("firm_id").alias("company_id"), "min_contract_value", "max_contract_value", "preferred_regions", "excluded_categories", "keywords"),
        "saved_contracts": v.saved.select("user_email", "notice_id", "contract_title", "buyer_name", "contract_value", "deadline", "status", "saved_at"),
    }


# What each table shows of a read row: its key, a text, and a number.
SHOWN = {
    "users": ("email", "notification_frequency", "cast(is_active as int)"),
    "audit_logs": ("cast(id as string)", "action", "cast(details['status'] as int)"),
    "conversations": ("id", "firm_id", "cast(user_id as int)"),
    "messages": ("id", "role", "length(content)"),
    "company_profiles": ("firm_id", "company_name", "onboarding_completed"),
    "company_capabilities": ("cast(id as string)", "capability_text", "company_id"),
    "past_wins": ("description", "buyer_name", "contract_value"),
    "search_preferences": ("cast(company_id as string)", "concat_ws('|', keywords)", "min_contract_value"),
    "saved_contracts": ("concat(user_email, notice_id)", "status", "contract_value"),
}


@case("scan_nine_tables", with_views("users requests_log convs messages firms capabilities past_wins preferences saved", r"""
    SELECT 'users' AS tbl, email AS key, notification_frequency AS said, is_active::INT::DOUBLE AS num FROM users
    UNION ALL SELECT 'audit_logs', event_id::VARCHAR, method, status_code FROM requests_log
    UNION ALL SELECT 'conversations', conversation_id::VARCHAR, firm_id, user_id FROM convs
    UNION ALL SELECT 'messages', message_id, role, length(content) FROM messages
    UNION ALL SELECT 'company_profiles', firm_id, company_name, company_id % 3 FROM firms
    UNION ALL SELECT 'company_capabilities', capability_id::VARCHAR, capability_text, regexp_extract(firm_id, '([0-9]+)$', 1)::BIGINT FROM capabilities
    UNION ALL SELECT 'past_wins', win_id, buyer_name, round(contract_value, 2) FROM past_wins
    UNION ALL SELECT 'search_preferences', regexp_extract(firm_id, '([0-9]+)$', 1)::BIGINT::VARCHAR, array_to_string(keywords, '|'), round(min_contract_value, 2) FROM preferences
    UNION ALL SELECT 'saved_contracts', user_email || notice_id, status, round(contract_value, 2) FROM saved"""))
def scan_nine_tables(v: Views):
    """Each relational table stored with its schema and read back by it."""
    root, out = folder(v, "tables"), None
    for name, rows in relational(v).items():
        want = tables.schema(name)
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]).write.parquet(f"{root}/{name}")
        key, said, num = SHOWN[name]
        read = tables.scan_table(v.spark, root, name).selectExpr(f"'{name}' as tbl", f"{key} as key", f"{said} as said", f"round(cast({num} as double), 2) as num")
        out = read if out is None else out.unionByName(read)
    return out


@case("validate_all_rules", with_views("saved users raw_notices past_wins", f"""WITH {PARSED}
    SELECT kind, rule, n AS rejected FROM (
      SELECT 'past_win' AS kind, 'title length' AS rule, count(*) FILTER (length(repeat(p_name, p_size)) > 500) AS n FROM part
      UNION ALL SELECT 'past_win', 'buyer length', count(*) FILTER (length(repeat(p_type, p_size % 20)) > 255 OR p_size = 7) FROM part
      UNION ALL SELECT 'past_win', 'value', count(*) FILTER (p_retailprice - 1000 < 0) FROM part
      UNION ALL SELECT 'past_win', 'award date', count(*) FILTER (p_size % 9 = 0) FROM part
      UNION ALL SELECT 'saved', 'title length', count(*) FILTER (length(repeat(contract_title, 1 + length(notice_id) % 12)) > 500) FROM saved
      UNION ALL SELECT 'saved', 'status', count(*) FILTER (status = 'lost') FROM saved
      UNION ALL SELECT 'saved', 'notes length', count(*) FILTER (length(repeat(contract_title, 30)) > 1000) FROM saved
      UNION ALL SELECT 'email_settings', 'frequency', count(*) FILTER (balance < 100) FROM users
      UNION ALL SELECT 'notice', 'missing id', count(*) FILTER (notice_id = 'UNKNOWN') FROM judged) WHERE n > 0"""))
def validate_all_rules(v: Views):
    """Broken rules counted for past wins, saved notices, mail settings and notices; the other two kinds have queries of their own."""
    from checks.cases_ingest import parsed

    part = v.table("part").select(
        F.expr("repeat(p_name, p_size)").alias("contract_title"), F.expr("case when p_size <> 7 then repeat(p_type, p_size % 20) end").alias("buyer_name"),
        (F.col("p_retailprice") - 1000).alias("contract_value"), F.expr("case when p_size % 9 <> 0 then date'2020-01-01' end").alias("award_date"),
    )
    saved = v.saved.select(
        F.expr("repeat(contract_title, 1 + length(notice_id) % 12)").alias("contract_title"), "buyer_name",
        F.when(F.col("status") == "lost", "gone").otherwise(F.col("status")).alias("status"), F.expr("repeat(contract_title, 30)").alias("notes"),
    )
    mail = v.users.select(F.when(F.col("balance") < 100, "hourly").otherwise(F.col("notification_frequency")).alias("notification_frequency"))
    out = None
    for kind, rows in (("past_win", part), ("saved", saved), ("email_settings", mail), ("notice", parsed(v))):
        counts = quality.rule_counts(rows, kind).select(F.lit(kind).alias("kind"), "rule", "rejected")
        out = counts if out is None else out.unionByName(counts)
    return out
