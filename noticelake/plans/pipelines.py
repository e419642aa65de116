"""Whole pipelines, from raw input to a table, as chains of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from noticelake.functions import display, text as tx
from noticelake.operators import chunking, ingest, scoring, vectors
from noticelake.session import staged
from noticelake.sources.store import BucketTable

# Fixed value: where a notice can be read.
NOTICE_BASE_URL = "https://www.contractsfinder.service.gov.uk/notice/"


def csv_sync(raw: DataFrame, state: DataFrame, as_of: Column, order: str, naive: str = "drop") -> DataFrame:
    """Raw CSV rows into the stored notices: parse, filter, one row per id (highest ``order``), upsert."""
    opened = ingest.filter_open_csv(ingest.parse_csv_notices(raw, (order,)), as_of, naive)
    return ingest.upsert(state, opened.drop("status", "closing_naive"), "notice_id", order)


def observed_sync(raw: DataFrame, table: BucketTable, as_of: Column, naive: str = "drop") -> dict:
    """One run of a sync into ``table``, with its ``fetched``, ``kept`` and ``stored`` rows and ``status``.

    The numbers are observed while the rows pass on their way to the table, so no row is read again to
    be counted. ``raw`` has the table's ``order`` as a column; of several rows with one id the highest is stored.
    """
    seen, taken, stored = Observation("seen"), Observation("taken"), Observation("stored")
    count = F.count(F.lit(1)).alias("n")
    parsed = ingest.parse_csv_notices(raw, (table.order,)).observe(seen, count)
    opened = ingest.filter_open_csv(parsed, as_of, naive).drop("status", "closing_naive").observe(taken, count)
    table.upsert(ingest.latest_by(opened, table.keys, table.order).observe(stored, count), distinct=True)
    run = {"fetched": seen.get["n"], "kept": taken.get["n"], "stored": stored.get["n"]}
    return run | {"status": "success" if run["stored"] else "no_data"}


def ocds_sync(releases: DataFrame, state: DataFrame, as_of: Column, order: str = "published_date", naive: str = "drop") -> DataFrame:
    """Releases into the stored notices."""
    active = ingest.filter_active_ocds(ingest.flatten_ocds(releases), as_of, naive).drop("tender_status", "closing_naive")
    return ingest.upsert(state, active.withColumn("_order", F.col(order)), "notice_id", "_order")


def index_notices(notices: DataFrame, provider) -> DataFrame:
    """Points of notices with the vector their provider gives for title and description."""
    points = ingest.notice_points(notices)
    made = provider(points.select("point_id", "embedding_text"), "point_id", "embedding_text")
    return points.join(made.select("point_id", "embedding"), "point_id", "left")


def index_documents(docs: DataFrame, provider, user: str = "user_id", text: str = "text") -> DataFrame:
    """Uploaded texts to chunk rows with vectors, keyed by (document_id, chunk_index)."""
    chunks = chunking.document_chunks(docs, user, text)
    key = F.concat_ws("#", "document_id", F.col("chunk_index").cast("string"))
    keyed = chunks.withColumn("chunk_id", key)
    made = provider(keyed.select("chunk_id", "chunk_text"), "chunk_id", "chunk_text")
    return keyed.join(made.select("chunk_id", "embedding"), "chunk_id", "left")


def recommend_from_texts(capability_rows: DataFrame, points: DataFrame, provider, limit: int, tables: dict[str, DataFrame]) -> DataFrame:
    """Notices for every firm that has capabilities, from texts alone: the firm's first capability texts
    make a query, the provider turns it into a vector, and search, scores and rank follow.

    ``points`` must carry vectors of the same provider.
    """
    queries = scoring.capability_queries(capability_rows)
    made = provider(queries, "firm_id", "query_text").where("embedding IS NOT NULL").select("firm_id", "embedding")
    return scoring.recommend_notices(made, points, limit, tables)


def match_documents(chunks: DataFrame, points: DataFrame, notices: DataFrame, as_of: Column, limit: int, user: str = "user_id") -> DataFrame:
    """Notices nearest to the mean of each user's document vectors, new ones first.

    Twice the limit is searched, scores are rounded to three decimals, then ordered and cut.
    """
    queries = vectors.centroids(chunks, user).withColumnRenamed(user, "query_id")
    pool = vectors.payload_filter(points, document_type="contract_opportunity")
    hits = staged(vectors.vector_topk(queries, pool, 2 * limit), "document-hits")
    full = notices
    for name, empty in (("cpv_codes", F.array().cast("array<string>")), ("additional_text", F.lit(None).cast("string"))):
        full = full if name in notices.columns else full.withColumn(name, empty)
    # Display texts are made for the hits only.
    wanted = full.withColumn("point_id", tx.md5_uuid("notice_id")).join(hits.select("point_id").distinct(), "point_id", "left_semi")
    about = wanted.select(
        "point_id", "notice_id", "title", "buyer_name", "value", "closing_date",
        "published_date", "region", "cpv_codes", display.display_text().alias("content"),
    )
    shown = hits.join(about, "point_id").withColumns(
        {"score": F.round("score", 3), "is_new": display.is_new("published_date", as_of)}
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("is_new"), F.desc("score"), F.asc("rank"))
    return (
        shown.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= limit)
        .select(
            F.col("query_id").alias(user), "place", F.col("point_id").alias("contract_id"), "notice_id", "title",
            F.col("buyer_name").alias("buyer"), "value", F.col("closing_date").alias("deadline"), "published_date",
            "score", "is_new", tx.notice_url("notice_id", NOTICE_BASE_URL).alias("url"),
            tx.preview("content").alias("description"),
            F.coalesce("cpv_codes", F.array().cast("array<string>")).alias("cpv_codes"), "region",
        )
    )
