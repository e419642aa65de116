"""Queries over vectors: providers, cosine, top-k search, centroids, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cases_ingest import CODES_SQL, DISPLAY_SQL, squeeze, with_codes
from checks.registry import case
from checks.views import AS_OF_SQL, Views, as_of, with_views
from noticelake.functions import text as tx, vector as vx
from noticelake.operators import chunking, state, vectors
from noticelake.plans import pipelines

COS = "coalesce(list_cosine_similarity({a}, {b}), 0)"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def topk_sql(queries: str, pool: str, k: int) -> str:
    """Best k points per query: (query_id, point_id, notice_id, score, rank)."""
    return f"""hits AS (SELECT * FROM (
        SELECT q.query_id, p.point_id, p.notice_id, round({cos('q.embedding', 'p.embedding')}, 9) AS score,
               row_number() OVER (PARTITION BY q.query_id ORDER BY round({cos('q.embedding', 'p.embedding')}, 9) DESC, p.point_id) AS rank
        FROM ({queries}) q, ({pool}) p) WHERE rank <= {k})"""


NOTICES = "SELECT * FROM points WHERE document_type = 'contract_opportunity'"


@case("embed", with_views("notices", "SELECT notice_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM notices JOIN embeddings USING (vec_id)"))
def embed(v: Views):
    rows = vectors.embed_lookup(v.notices.select("notice_id", "vec_id"), "vec_id", v.embeddings)
    return rows.select("notice_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@case("embed_hash", f"""
    WITH w AS (SELECT doc_id, md5(u) AS h FROM (SELECT doc_id, unnest(string_split({squeeze('lower(text)')}, ' ')) AS u FROM documents) WHERE u <> ''),
    slots AS (SELECT doc_id, ('0x' || left(h, 6))::INT % 64 AS slot, sum(CASE WHEN h[32] < '8' THEN 1 ELSE -1 END) AS n FROM w GROUP BY 1, 2),
    len AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM slots GROUP BY 1)
    SELECT doc_id, slot, round((n / l)::FLOAT::DOUBLE, 5) AS x FROM slots JOIN len USING (doc_id) WHERE n <> 0""")
def embed_hash(v: Views):
    made = vectors.embed_hash(v.table("documents"), "doc_id", "text")
    return made.select("doc_id", F.posexplode("embedding").alias("slot", "x")).where("x <> 0").select(
        "doc_id", "slot", F.round(F.col("x").cast("double"), 5).alias("x")
    )


@case("cosine", f"SELECT e.vec_id, round({cos('e.embedding::DOUBLE[]', 'n.embedding::DOUBLE[]')}, 6) AS similarity FROM embeddings e JOIN embeddings n ON n.vec_id = e.label")
def cosine(v: Views):
    e = v.table("embeddings")
    other = e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    return e.join(other, "label").select("vec_id", F.round(vx.cosine("embedding", "other"), 6).alias("similarity"))


@case("vector_topk", with_views("points requests", f"WITH {topk_sql('SELECT * FROM requests', NOTICES, 10)} SELECT query_id, point_id, round(score, 6) AS score, rank FROM hits"))
def vector_topk(v: Views):
    pool = vectors.payload_filter(v.points, document_type="contract_opportunity")
    return vectors.vector_topk(v.requests, pool, 10).withColumn("score", F.round("score", 6))


@case("overfetch", with_views("points requests", f"WITH {topk_sql('SELECT * FROM requests', NOTICES, 20)} SELECT query_id, count(*) AS candidates FROM hits GROUP BY 1"))
def overfetch(v: Views):
    pool = vectors.payload_filter(v.points, document_type="contract_opportunity")
    return vectors.vector_topk(v.requests, pool, 2 * 10).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


@case("payload_filter", with_views("points", """
    SELECT point_id, notice_id FROM points WHERE document_type = 'contract_opportunity' AND region = 'EUROPE' AND m_notice_type = '2-HIGH'"""))
def payload_filter(v: Views):
    wanted = {"region": "EUROPE", "notice_type": "2-HIGH"}
    return vectors.payload_filter(v.points, wanted, "contract_opportunity").select("point_id", "notice_id")


@case("shape_hits", with_views("points", """
    SELECT point_id, content, document_type, CASE WHEN document_type = 'legal_document' THEN coalesce(page, 1) END AS page, document_id, notice_id,
           buyer_name, value, region FROM points"""))
def shape_hits(v: Views):
    return vectors.shape_hits(v.points).drop("metadata")


@case("search_notices", with_views("points requests", f"""
    WITH {topk_sql('SELECT * FROM requests', NOTICES + " AND region = 'ASIA'", 20)}
    SELECT h.query_id, h.point_id, h.rank FROM hits h JOIN points p USING (point_id) WHERE p.value BETWEEN 50000 AND 300000"""))
def search_notices(v: Views):
    return vectors.search_notices(v.requests, v.points, 20, region="ASIA", min_value=50000.0, max_value=300000.0).select(
        "query_id", "point_id", "rank"
    )


@case("search_notices_pre", with_views("points requests", f"""
    WITH {topk_sql('SELECT * FROM requests', NOTICES + " AND value >= 50000", 20)} SELECT query_id, point_id, rank FROM hits"""))
def search_notices_pre(v: Views):
    return vectors.search_notices(v.requests, v.points, 20, min_value=50000.0, range_mode="pre").select("query_id", "point_id", "rank")


@case("search_result_row", with_views("points requests", f"""
    WITH {topk_sql('SELECT * FROM requests', NOTICES, 5)}
    SELECT h.query_id, p.notice_id, m_title AS title, buyer_name, coalesce(m_description, m_title) AS description, value, region,
           strftime(m_closing_date, '%Y-%m-%d') AS closing_date, round(score, 6) AS score, m_notice_type AS notice_type
    FROM hits h JOIN points p USING (point_id)"""))
def search_result_row(v: Views):
    hits = vectors.with_points(vectors.search_notices(v.requests, v.points, 5), v.points.drop("embedding"))
    return vectors.search_result_row(hits).select(
        "query_id", "notice_id", "title", "buyer_name", "description", "value", "region",
        F.date_format("closing_date", "yyyy-MM-dd").alias("closing_date"), F.round("score", 6).alias("score"), "notice_type",
    )


CHUNKS_SQL = "chunks AS (SELECT doc_id % (SELECT n FROM ns) AS user_id, embedding::DOUBLE[] AS embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT n FROM nv))"
CENTROID_SQL = f"""{CHUNKS_SQL},
    parts AS (SELECT user_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM chunks),
    means AS (SELECT user_id, pos, avg(x) AS m FROM parts GROUP BY 1, 2)"""


def user_chunks(v: Views):
    """Documents as one-chunk uploads of users, with stored vectors."""
    nv, ns = v.size("embeddings"), v.size("supplier")
    docs = v.table("documents").select((F.col("doc_id") % ns).alias("user_id"), (F.col("doc_id") % nv).alias("vec_id"))
    return docs.join(v.embeddings, "vec_id")


@case("user_centroid", with_views("ns nv", f"WITH {CENTROID_SQL} SELECT user_id, pos::INT AS pos, round(m, 6) AS m FROM means"))
def user_centroid(v: Views):
    return vectors.centroids(user_chunks(v), "user_id").select("user_id", F.posexplode("embedding").alias("pos", "m")).withColumn(
        "m", F.round("m", 6)
    )


MATCH_AS_OF = "2000-01-01 00:00:00"


@case("match_documents", with_views("points ns nv notices", f"""{CODES_SQL}, {CENTROID_SQL},
    queries AS (SELECT user_id AS query_id, list(m ORDER BY pos) AS embedding FROM means GROUP BY 1),
    {topk_sql('SELECT * FROM queries', NOTICES, 20)},
    shown AS (SELECT h.*, round(h.score, 3) AS s3, n.title, n.buyer_name, n.published_date, {DISPLAY_SQL} AS content, codes,
                     floor(epoch(TIMESTAMP '{MATCH_AS_OF}' - n.published_date) / 86400) <= 7 AS is_new
              FROM hits h JOIN coded n USING (notice_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_new DESC, s3 DESC, rank) AS place FROM shown)
    SELECT query_id AS user_id, place::INT AS place, notice_id, title, buyer_name AS buyer, s3 AS score, is_new, left(content, 200) || '...' AS description,
           replace(replace(codes, 'None', ''), ', ', '|') AS cpv_codes FROM placed WHERE place <= 10"""))
def match_documents(v: Views):
    when = F.lit(MATCH_AS_OF).cast("timestamp")
    return pipelines.match_documents(user_chunks(v), v.points, with_codes(v), when, 10).select(
        "user_id", "place", "notice_id", "title", "buyer", "score", "is_new", "description", F.array_join("cpv_codes", "|").alias("cpv_codes")
    )


@case("vector_diagnostics", with_views("capabilities notice_vectors", f"""
    SELECT capability_id, n.notice_id, round(sqrt(list_dot_product(c.embedding, c.embedding)), 4) AS vector_norm, len(c.embedding)::INT AS vector_dimensions,
           round({cos('n.embedding', 'c.embedding')}, 4) AS similarity_score, round({cos('n.embedding', 'c.embedding')}, 4) = 0 AS zero_similarity
    FROM capabilities c JOIN notice_vectors n ON n.notice_id = 'N-' || capability_id WHERE c.embedding IS NOT NULL"""))
def vector_diagnostics(v: Views):
    n = v.notice_vectors.withColumnRenamed("embedding", "notice_vector")
    met = v.capabilities.where("embedding IS NOT NULL").withColumn("notice_id", F.concat(F.lit("N-"), F.col("capability_id").cast("string"))).join(n, "notice_id")
    return vectors.vector_diagnostics(met).select(
        "capability_id", "notice_id", "vector_norm", "vector_dimensions", "similarity_score", "zero_similarity"
    )


@case("count_points", with_views("points", "SELECT document_type, firm_id, count(*) AS points FROM points GROUP BY 1, 2"))
def count_points(v: Views):
    return vectors.point_counts(v.points)


@case("collection_stats", with_views("points capabilities", """
    SELECT 'notices' AS collection, count(*) AS points, count(embedding) AS vectors FROM points WHERE document_type = 'contract_opportunity'
    UNION ALL SELECT 'documents', count(*), count(embedding) FROM points WHERE document_type = 'legal_document'
    UNION ALL SELECT 'capabilities', count(*), count(embedding) FROM capabilities"""))
def collection_stats(v: Views):
    return vectors.collection_stats({
        "notices": v.points.where("document_type = 'contract_opportunity'"),
        "documents": v.points.where("document_type = 'legal_document'"), "capabilities": v.capabilities,
    })


@case("embed_missing", with_views("capabilities", """
    SELECT capability_id, CASE WHEN vec_id IS NULL THEN md5('cap-' || capability_id)::UUID::VARCHAR ELSE 'v-' || vec_id END AS vector_id, true AS stored FROM capabilities"""))
def embed_missing(v: Views):
    rows = v.capability_rows.withColumn("vector_id", F.concat(F.lit("v-"), F.col("vec_id").cast("string")))
    store = v.embeddings.select(F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("vector_id"), "embedding")
    written, filled = vectors.embed_missing(rows, store, "capability_id", "capability_text", vectors.embed_hash)
    known = filled.select("vector_id", F.lit(True).alias("stored"))
    return written.join(known, "vector_id", "left").select("capability_id", "vector_id", F.coalesce("stored", F.lit(False)).alias("stored"))


@case("capability_vectors", with_views("capabilities", "SELECT capability_id, firm_id, round(embedding[1], 6) AS first FROM capabilities WHERE embedding IS NOT NULL"))
def capability_vectors(v: Views):
    """Capabilities with their vector, those without one left out."""
    met = vectors.capability_vectors(v.capability_rows, v.embeddings)
    return met.select("capability_id", "firm_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@case("index_documents", with_views("ns", f"""WITH words AS (SELECT doc_id, list_filter(string_split({squeeze('text')}, ' '), lambda w: w <> '') AS w, {squeeze('text')} AS clean FROM documents),
  win AS (SELECT doc_id, clean, s.i, array_to_string(w[(s.i * 800 + 1):(s.i * 800 + 1000)], ' ') AS chunk_text
          FROM words, LATERAL (SELECT unnest(range(0, ((len(w) + 799) // 800)::BIGINT)) AS i) s WHERE len(w) > 0),
  kept AS (SELECT *, 'user_' || (doc_id % (SELECT n FROM ns)) || '_doc_' || left(md5(clean), 12) AS document_id,
                  (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index FROM win WHERE length(chunk_text) > 100)
  SELECT document_id, chunk_index, count(*) AS copies FROM kept GROUP BY 1, 2"""))
def index_documents(v: Views):
    ns = v.size("supplier")
    docs = v.table("documents").select((F.col("doc_id") % ns).alias("user_id"), "text")
    return chunking.document_chunks(docs).groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("copies"))


@case("scroll_points", with_views("points", f"""
    SELECT point_id, notice_id FROM points WHERE document_type = 'contract_opportunity' AND m_closing_date >= {AS_OF_SQL} ORDER BY point_id LIMIT 50"""))
def scroll_points(v: Views):
    wanted = (F.col("document_type") == "contract_opportunity") & (F.col("metadata.closing_date") >= as_of())
    return state.scroll_points(v.points, 50, wanted).select("point_id", "notice_id")


@case("is_new", with_views("notices", f"SELECT notice_id, floor(epoch({AS_OF_SQL} - published_date) / 86400) <= 7 AS is_new FROM notices"))
def is_new(v: Views):
    from noticelake.functions import display

    return v.notices.select("notice_id", display.is_new("published_date", as_of()).alias("is_new"))


@case("preview", with_views("notices", "SELECT notice_id, CASE WHEN length(description) > 0 THEN left(description, 200) || '...' ELSE '' END AS preview FROM notices"))
def preview(v: Views):
    return v.notices.select("notice_id", tx.preview("description").alias("preview"))


@case("notice_url", with_views("notices", f"SELECT notice_id, '{pipelines.NOTICE_BASE_URL}' || notice_id AS url FROM notices"))
def notice_url(v: Views):
    return v.notices.select("notice_id", tx.notice_url("notice_id", pipelines.NOTICE_BASE_URL).alias("url"))
