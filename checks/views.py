"""Domain tables over the shared Parquet tables: once as DataFrames, once as SQL for the cross-check.

Every view covers its whole source tables. Variety in the data (missing preferences, inactive
users, date formats) follows from attributes of the rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text as tx
from noticelake.session import prepare

AS_OF = "1998-01-01 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def days(n: int):
    return F.expr(f"INTERVAL {n} DAY")


class Views:
    """DataFrames over one data directory; each is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir.rstrip("/")
        self.sizes: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    def size(self, name: str) -> int:
        if name not in self.sizes:
            self.sizes[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet").count()
        return self.sizes[name]

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))

    @cached_property
    def buyers(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    @cached_property
    def notices(self) -> DataFrame:
        nd, nv = self.size("documents"), self.size("embeddings")
        orders = self.table("orders").withColumns({"doc_id": F.col("o_orderkey") % nd, "vec_id": F.col("o_orderkey") % nv})
        lead = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
        titles = lead.join(self.table("part"), "p_partkey").select(
            F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("part_title")
        )
        customers = self.table("customer").join(self.buyers, F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            orders.join(customers.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
            .join(titles, "o_orderkey", "left")
            .join(self.table("documents").select("doc_id", "text"), "doc_id")
            .select(
                F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("notice_id"),
                F.coalesce("part_title", F.lit("Untitled Contract")).alias("title"),
                F.col("text").alias("description"),
                F.col("n_name").alias("buyer_name"),
                F.col("r_name").alias("region"),
                F.col("o_totalprice").alias("value"),
                F.col("o_orderdate").alias("published_date"),
                (F.col("o_orderdate") + days(90)).alias("closing_date"),
                F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
                F.col("o_orderpriority").alias("notice_type"),
                "vec_id",
            )
        )

    @cached_property
    def notice_vectors(self) -> DataFrame:
        nv = self.size("embeddings")
        keyed = self.table("orders").select(
            F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("notice_id"), (F.col("o_orderkey") % nv).alias("vec_id")
        )
        return keyed.join(self.embeddings, "vec_id").select("notice_id", "embedding")

    @cached_property
    def points(self) -> DataFrame:
        """Notices as points with vectors, beside the documents as points of the other type."""
        notices = self.notices.join(self.embeddings, "vec_id").select(
            tx.md5_uuid("notice_id").alias("point_id"), F.lit("contract_opportunity").alias("document_type"),
            F.col("title").alias("content"), "notice_id", "buyer_name", "value", "region",
            F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("document_id"),
            F.lit(None).cast("string").alias("firm_id"),
            F.struct("title", "description", "notice_type", "closing_date").alias("metadata"), "embedding",
        )
        nv, ns = self.size("embeddings"), self.size("supplier")
        docs = self.table("documents").withColumns({"vec_id": F.col("doc_id") % nv, "s": F.col("doc_id") % ns})
        labels = self.table("labels").select("doc_id", F.col("quality").alias("page"))
        none = lambda t: F.lit(None).cast(t)
        legal = (
            docs.join(labels, "doc_id", "left").join(self.embeddings, "vec_id")
            .select(
                tx.md5_uuid(F.concat(F.lit("D-"), F.col("doc_id").cast("string"))).alias("point_id"),
                F.lit("legal_document").alias("document_type"), F.col("text").alias("content"),
                none("string").alias("notice_id"), none("string").alias("buyer_name"), none("double").alias("value"),
                none("string").alias("region"), F.col("page").cast("int").alias("page"),
                F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("document_id"),
                F.concat(F.lit("firm-supplier#"), F.lpad(F.col("s").cast("string"), 9, "0")).alias("firm_id"),
                F.struct(
                    F.col("lang").alias("title"), none("string").alias("description"), F.col("source").alias("notice_type"),
                    none("timestamp").alias("closing_date"),
                ).alias("metadata"),
                "embedding",
            )
        )
        return notices.unionByName(legal)

    @cached_property
    def firms(self) -> DataFrame:
        return self.table("supplier").join(self.buyers, F.col("s_nationkey") == F.col("n_nationkey")).select(
            tx.firm_slug("s_name").alias("firm_id"), F.col("s_name").alias("company_name"), F.col("r_name").alias("region"),
            F.col("s_suppkey").alias("company_id"), F.col("s_acctbal").alias("balance"),
        )

    def slug(self, key: str):
        """Firm id of a supplier number (the slug of its name)."""
        return F.concat(F.lit("firm-supplier#"), F.lpad(F.col(key).cast("string"), 9, "0"))

    @cached_property
    def capability_rows(self) -> DataFrame:
        nv, ns = self.size("embeddings"), self.size("supplier")
        parts = self.table("part").withColumn("s", F.col("p_partkey") % ns)
        return parts.select(
            F.col("p_partkey").alias("capability_id"), self.slug("s").alias("firm_id"),
            F.concat_ws(" ", "p_name", "p_type").alias("capability_text"), F.col("p_brand").alias("category"),
            F.when(F.col("p_size") >= 5, F.col("p_partkey") % nv).alias("vec_id"),
        )

    @cached_property
    def capabilities(self) -> DataFrame:
        return self.capability_rows.join(self.embeddings, "vec_id", "left")

    @cached_property
    def past_wins(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(
            F.max("l_extendedprice").alias("contract_value"), F.max("l_shipdate").alias("shipped")
        )
        won = self.table("orders").where("o_orderstatus = 'F'").join(
            self.table("customer").join(self.buyers, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        return lines.join(won, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("win_id"),
            self.slug("l_suppkey").alias("firm_id"), F.col("n_name").alias("buyer_name"), "contract_value",
            F.to_date("shipped").alias("award_date"),
        )

    @cached_property
    def preferences(self) -> DataFrame:
        ns = self.size("supplier")
        words = self.table("part").select(
            F.col("p_partkey").alias("k"), F.split("p_name", " ").alias("keywords"), F.array(F.lower("p_type")).alias("excluded_categories")
        )
        firms = self.firms.withColumn("k2", F.col("company_id") + ns)
        own = words.select(F.col("k").alias("company_id"), "keywords")
        other = words.select(F.col("k").alias("k2"), "excluded_categories")
        low = F.when(F.col("balance") < 2000, 0.0).otherwise(F.col("balance") * 10)
        high = F.when(F.col("balance") > 8000, None).otherwise(F.abs("balance") * 50 + 100000)
        regions = F.when(F.col("balance") < 3000, F.array().cast("array<string>")).otherwise(F.array("region"))
        # Firms in debt have stated no preferences.
        return firms.where("balance >= 500").join(own, "company_id").join(other, "k2").select(
            "firm_id", low.alias("min_contract_value"), high.alias("max_contract_value"), regions.alias("preferred_regions"),
            "excluded_categories", "keywords",
        )

    @cached_property
    def users(self) -> DataFrame:
        ns = self.size("supplier")
        c = self.table("customer").withColumn("s", F.col("c_custkey") % ns)
        segment = F.col("c_mktsegment")
        sent = F.when(F.col("c_acctbal") < 3000, None).when(
            F.col("c_acctbal") < 6000, F.lit("1997-12-30 12:00:00")
        ).otherwise(F.lit("1997-12-29 00:00:00"))
        return c.select(
            F.col("c_custkey").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.col("c_name").alias("full_name"),
            F.when(segment == "HOUSEHOLD", "firm-none").otherwise(self.slug("s")).alias("firm_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"), (segment != "BUILDING").alias("email_notifications_enabled"),
            F.when(segment == "FURNITURE", "weekly").when(segment == "BUILDING", "never").otherwise("daily").alias("notification_frequency"),
            sent.cast("timestamp").alias("last_email_sent_at"), F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def saved(self) -> DataFrame:
        status = F.create_map(*[F.lit(x) for x in (
            "1-URGENT", "bidding", "2-HIGH", "interested", "3-MEDIUM", "won", "4-NOT SPECIFIED", "lost", "5-LOW", "interested")])
        o = self.table("orders").withColumn("notice_id", F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")))
        people = self.users.select(F.col("user_id").alias("o_custkey"), F.col("email").alias("user_email"))
        about = self.notices.select("notice_id", F.col("title").alias("contract_title"), "buyer_name")
        return o.join(people, "o_custkey").join(about, "notice_id").select(
            "user_email", "notice_id", "contract_title", "buyer_name", F.col("o_totalprice").alias("contract_value"),
            (F.col("o_orderdate") + days(90)).alias("deadline"), status[F.col("o_orderpriority")].alias("status"),
            F.lit(None).cast("string").alias("notes"), F.col("o_orderdate").alias("saved_at"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Firms beside the notices whose order they have a line in."""
        return self.table("lineitem").select(
            self.slug("l_suppkey").alias("firm_id"), F.concat(F.lit("N-"), F.col("l_orderkey").cast("string")).alias("notice_id")
        ).distinct()

    @cached_property
    def requests(self) -> DataFrame:
        """One search request per firm, with the stored vector at its number."""
        nv = self.size("embeddings")
        return self.firms.withColumn("vec_id", F.col("company_id") % nv).join(self.embeddings, "vec_id").select(
            F.col("firm_id").alias("query_id"), "firm_id", "embedding"
        )

    @property
    def scoring_tables(self) -> dict[str, DataFrame]:
        return {
            "notices": self.notices, "notice_vectors": self.notice_vectors, "firms": self.firms,
            "capabilities": self.capabilities, "past_wins": self.past_wins, "preferences": self.preferences,
        }

    @cached_property
    def requests_log(self) -> DataFrame:
        """Web requests made of the events."""
        kind = F.col("event_type")
        user = F.col("user_id").cast("string")
        method = F.when(kind == "signup", "POST").when(kind == "purchase", "DELETE").when(kind == "click", "POST").otherwise("GET")
        path = (
            F.when(kind == "signup", "/auth/register").when(kind == "purchase", F.concat(F.lit("/documents/"), user))
            .when((kind == "click") & (F.col("value") < 10), "/documents/upload").when(kind == "click", "/query")
            .when((kind == "error") & (F.col("value") < 5), "/health/live").when(kind == "error", "/auth/login")
            .when(F.col("value") < 5, "/docs").when(F.col("value") < 20, F.concat(F.lit("/conversations/"), user))
            .otherwise(F.concat(F.lit("/contracts/N-"), user))
        )
        return self.table("events").select(
            "event_id", "ts", user.alias("user_id"), F.lit(None).cast("string").alias("firm_id"), method.alias("method"),
            path.alias("path"), F.when(kind == "error", 500).otherwise(200).alias("status_code"),
            F.col("value").alias("latency_seconds"), F.lit(None).cast("string").alias("ip_address"),
            F.lit(None).cast("string").alias("user_agent"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        return self.table("conversations").select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
            F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), "turn",
            F.timestamp_seconds(F.unix_seconds(base) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("timestamp"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        """One conversation per customer; those whose number has no turns stay empty."""
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        ns = self.size("supplier")
        return self.table("customer").select(
            F.col("c_custkey").alias("conversation_id"), (F.col("c_custkey") % ns).alias("user_id"), self.slug_nation().alias("firm_id"),
            F.timestamp_seconds(F.unix_seconds(base) + F.col("c_custkey")).alias("updated_at"),
        )

    def slug_nation(self):
        return F.concat(F.lit("firm-"), F.col("c_nationkey").cast("string"))

    @cached_property
    def legal_docs(self) -> DataFrame:
        """Conversations as paged texts with numbered clauses."""
        turn = F.col("e.turn").cast("string")
        part = lambda e: F.concat(
            F.lit("[Page "), (e["turn"] + 1).cast("string"), F.lit("]\n"), (e["turn"] + 1).cast("string"), F.lit(". "), e["text"]
        )
        listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
        return self.table("conversations").groupBy("conv_id").agg(
            F.array_join(F.transform(listed, part), "\n\n").alias("text")
        ).select(F.col("conv_id").alias("doc_id"), "text")

    @cached_property
    def raw_notices(self) -> DataFrame:
        """Notices as untyped CSV-like rows in several formats."""
        n = self.notices.withColumn("k", F.substring("notice_id", 3, 20).cast("long"))
        k = F.col("k")
        fmt = lambda c, shift: (
            F.when((k + shift) % 8 == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when((k + shift) % 8 == 1, F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")))
            .when((k + shift) % 8 == 2, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
            .when((k + shift) % 8 == 3, F.date_format(c, "dd/MM/yyyy"))
            .when((k + shift) % 8 == 4, F.date_format(c, "dd-MM-yyyy"))
            .when((k + shift) % 8 == 5, F.date_format(c, "yyyy-MM-dd"))
            .when((k + shift) % 8 == 6, F.date_format(c, "dd/MM/yyyy HH:mm:ss"))
            .otherwise(F.when(k % 3 == 0, "soon").when(k % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), F.date_format(c, "yyyy-MM-dd"), F.lit("\t"))))
        )
        cents = F.regexp_replace(F.format_number("value", 2), "^", "£")
        low = F.when(k % 5 == 0, "0").when(k % 5 == 1, cents).when(k % 5 == 2, F.lit("abc")).when(k % 5 == 3, "").otherwise(
            F.concat(F.lit(" "), cents, F.lit(" "))
        )
        cols = {
            "Notice Identifier": F.when(k % 97 == 0, " ").otherwise(F.col("notice_id")),
            "Title": F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit(" \n "))),
            "Organisation Name": F.when(k % 89 == 0, "").otherwise(F.col("buyer_name")),
            "Description": F.col("description"),
            "Region": F.col("region"),
            "Notice Type": F.col("notice_type"),
            "Status": F.when(F.col("status") == "open", F.when(k % 2 == 0, " OPEN ").otherwise("Open")).otherwise("Closed"),
            "Published Date": fmt("published_date", 3),
            "Closing Date": fmt("closing_date", 0),
            "Value Low": low,
            "Value High": cents,
            "Cpv Codes": F.concat(F.col("notice_type"), F.lit("; "), F.col("region"), F.lit(",, "), F.col("buyer_name"), F.lit(" ,")),
            "Suitable for SME": F.when(k % 4 == 0, "Yes").when(k % 4 == 1, " n").when(k % 4 == 2, "maybe").otherwise(""),
            "Contact Address 1": F.col("buyer_name"), "Contact Address 2": F.when(k % 2 == 0, " ").otherwise(" Floor 2 "),
            "Contact Town": F.col("region"), "Contact Postcode": F.when(k % 3 == 0, None).otherwise("AB1 2CD"),
        }
        from noticelake.sources.notices import CSV_COLUMNS

        return n.select("k", *[cols.get(c, F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS])


# ---- the same views in SQL ------------------------------------------------------------------------

SQL = {
    "nd": "SELECT count(*) AS n FROM documents",
    "nv": "SELECT count(*) AS n FROM embeddings",
    "ns": "SELECT count(*) AS n FROM supplier",
    "buyers": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "notices": """
        SELECT 'N-' || o_orderkey AS notice_id, coalesce(p_name || ' ' || lower(p_type), 'Untitled Contract') AS title,
               d.text AS description, n_name AS buyer_name, r_name AS region, o_totalprice AS value,
               o_orderdate AS published_date, o_orderdate + INTERVAL 90 DAY AS closing_date,
               CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status, o_orderpriority AS notice_type,
               o_orderkey % (SELECT n FROM nv) AS vec_id, o_orderkey AS k
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN buyers ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) f ON f.l_orderkey = o_orderkey
        LEFT JOIN part ON p_partkey = pk
        JOIN documents d ON d.doc_id = o_orderkey % (SELECT n FROM nd)""",
    "notice_vectors": "SELECT notice_id, embedding::DOUBLE[] AS embedding FROM notices JOIN embeddings USING (vec_id)",
    "points": """
        SELECT md5(notice_id)::UUID::VARCHAR AS point_id, 'contract_opportunity' AS document_type, title AS content, notice_id,
               buyer_name, value, region, NULL::INT AS page, NULL::VARCHAR AS document_id, NULL::VARCHAR AS firm_id,
               title AS m_title, description AS m_description, notice_type AS m_notice_type, closing_date AS m_closing_date,
               embedding::DOUBLE[] AS embedding
        FROM notices JOIN embeddings USING (vec_id)
        UNION ALL
        SELECT md5('D-' || d.doc_id)::UUID::VARCHAR, 'legal_document', text, NULL, NULL, NULL, NULL, quality::INT, 'D-' || d.doc_id,
               'firm-supplier#' || lpad((d.doc_id % (SELECT n FROM ns))::VARCHAR, 9, '0'), lang, NULL, source, NULL, embedding::DOUBLE[]
        FROM documents d LEFT JOIN labels USING (doc_id) JOIN embeddings ON vec_id = d.doc_id % (SELECT n FROM nv)""",
    "firms": """
        SELECT 'firm-' || translate(lower(s_name), ' _', '--') AS firm_id, s_name AS company_name, r_name AS region,
               s_suppkey AS company_id, s_acctbal AS balance
        FROM supplier JOIN buyers ON s_nationkey = n_nationkey""",
    "capabilities": """
        SELECT p_partkey AS capability_id, 'firm-supplier#' || lpad((p_partkey % (SELECT n FROM ns))::VARCHAR, 9, '0') AS firm_id,
               p_name || ' ' || p_type AS capability_text, p_brand AS category, embedding::DOUBLE[] AS embedding,
               CASE WHEN p_size >= 5 THEN p_partkey % (SELECT n FROM nv) END AS vec_id
        FROM part LEFT JOIN embeddings ON p_size >= 5 AND vec_id = p_partkey % (SELECT n FROM nv)""",
    "past_wins": """
        SELECT l_orderkey || '-' || l_suppkey AS win_id, 'firm-supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS firm_id,
               n_name AS buyer_name, contract_value, shipped::DATE AS award_date
        FROM (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS contract_value, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2)
        JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'
        JOIN customer ON o_custkey = c_custkey JOIN buyers ON c_nationkey = n_nationkey""",
    "preferences": """
        SELECT firm_id, CASE WHEN balance < 2000 THEN 0.0::DOUBLE ELSE balance * 10 END AS min_contract_value,
               CASE WHEN balance > 8000 THEN NULL ELSE abs(balance) * 50 + 100000 END AS max_contract_value,
               CASE WHEN balance < 3000 THEN []::VARCHAR[] ELSE [region] END AS preferred_regions,
               [lower(b.p_type)] AS excluded_categories, string_split(a.p_name, ' ') AS keywords
        FROM firms JOIN part a ON a.p_partkey = company_id JOIN part b ON b.p_partkey = company_id + (SELECT n FROM ns)
        WHERE balance >= 500""",
    "users": """
        SELECT c_custkey AS user_id, lower(c_name) || '@example.org' AS email, c_name AS full_name,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'firm-none'
                    ELSE 'firm-supplier#' || lpad((c_custkey % (SELECT n FROM ns))::VARCHAR, 9, '0') END AS firm_id,
               c_acctbal >= 0 AS is_active, c_mktsegment <> 'BUILDING' AS email_notifications_enabled,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'weekly' WHEN 'BUILDING' THEN 'never' ELSE 'daily' END AS notification_frequency,
               CASE WHEN c_acctbal < 3000 THEN NULL WHEN c_acctbal < 6000 THEN TIMESTAMP '1997-12-30 12:00:00'
                    ELSE TIMESTAMP '1997-12-29 00:00:00' END AS last_email_sent_at, c_acctbal AS balance
        FROM customer""",
    "saved": """
        SELECT email AS user_email, notice_id, title AS contract_title, buyer_name, o_totalprice AS contract_value,
               o_orderdate + INTERVAL 90 DAY AS deadline,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'bidding' WHEN '3-MEDIUM' THEN 'won' WHEN '4-NOT SPECIFIED' THEN 'lost'
                    ELSE 'interested' END AS status, NULL::VARCHAR AS notes, o_orderdate AS saved_at
        FROM orders JOIN users ON user_id = o_custkey JOIN notices ON notice_id = 'N-' || o_orderkey""",
    "pairs": "SELECT DISTINCT 'firm-supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS firm_id, 'N-' || l_orderkey AS notice_id FROM lineitem",
    "requests": """
        SELECT firm_id AS query_id, firm_id, embedding::DOUBLE[] AS embedding
        FROM firms JOIN embeddings ON vec_id = company_id % (SELECT n FROM nv)""",
    "requests_log": """
        SELECT event_id, ts, user_id::VARCHAR AS user_id,
               CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'DELETE' WHEN 'click' THEN 'POST' ELSE 'GET' END AS method,
               CASE WHEN event_type = 'signup' THEN '/auth/register' WHEN event_type = 'purchase' THEN '/documents/' || user_id
                    WHEN event_type = 'click' AND value < 10 THEN '/documents/upload' WHEN event_type = 'click' THEN '/query'
                    WHEN event_type = 'error' AND value < 5 THEN '/health/live' WHEN event_type = 'error' THEN '/auth/login'
                    WHEN value < 5 THEN '/docs' WHEN value < 20 THEN '/conversations/' || user_id ELSE '/contracts/N-' || user_id END AS path,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS latency_seconds
        FROM events""",
    "messages": """
        SELECT conv_id || '-' || turn AS message_id, conv_id AS conversation_id, role, text AS content, turn,
               TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS timestamp
        FROM conversations""",
    "convs": """
        SELECT c_custkey AS conversation_id, c_custkey % (SELECT n FROM ns) AS user_id, 'firm-' || c_nationkey AS firm_id,
               TIMESTAMP '2024-01-01' + to_seconds(c_custkey) AS updated_at
        FROM customer""",
    "legal_docs": r"""
        SELECT conv_id AS doc_id, string_agg('[Page ' || (turn + 1) || ']' || chr(10) || (turn + 1) || '. ' || text,
               chr(10) || chr(10) ORDER BY turn, text) AS text
        FROM conversations GROUP BY conv_id""",
    "raw_notices": r"""
        SELECT k, CASE WHEN k % 97 = 0 THEN ' ' ELSE notice_id END AS raw_id,
               '  ' || replace(title, ' ', ' ' || chr(10) || ' ') AS raw_title,
               CASE WHEN k % 89 = 0 THEN '' ELSE buyer_name END AS raw_buyer, description AS raw_description, region AS raw_region,
               CASE WHEN status = 'open' THEN CASE WHEN k % 2 = 0 THEN ' OPEN ' ELSE 'Open' END ELSE 'Closed' END AS raw_status,
               {published} AS raw_published, {closing} AS raw_closing,
               CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN cents WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE ' ' || cents || ' ' END AS raw_low,
               cents AS raw_high, notice_type || '; ' || region || ',, ' || buyer_name || ' ,' AS raw_cpv,
               CASE k % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n' WHEN 2 THEN 'maybe' ELSE '' END AS raw_sme,
               buyer_name AS a1, CASE WHEN k % 2 = 0 THEN ' ' ELSE ' Floor 2 ' END AS a2, region AS a3,
               CASE WHEN k % 3 = 0 THEN NULL ELSE 'AB1 2CD' END AS a4
        FROM (SELECT *, '£' || format('{{:,.2f}}', value) AS cents FROM notices)""",
}


def _date_formats(c: str, shift: int) -> str:
    return f"""CASE (k + {shift}) % 8 WHEN 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+01:00'
        WHEN 2 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime({c}, '%d/%m/%Y') WHEN 4 THEN strftime({c}, '%d-%m-%Y')
        WHEN 5 THEN strftime({c}, '%Y-%m-%d') WHEN 6 THEN strftime({c}, '%d/%m/%Y %H:%M:%S')
        ELSE CASE k % 3 WHEN 0 THEN 'soon' WHEN 1 THEN '  ' ELSE ' ' || strftime({c}, '%Y-%m-%d') || chr(9) END END"""


SQL["raw_notices"] = SQL["raw_notices"].format(
    published=_date_formats("published_date", 3), closing=_date_formats("closing_date", 0)
)

NEEDS = {
    "notices": ["nd", "nv", "buyers"], "notice_vectors": ["notices"], "points": ["notices", "ns"], "firms": ["buyers"],
    "capabilities": ["nv", "ns"], "past_wins": ["buyers"], "preferences": ["firms", "ns"], "users": ["ns"],
    "saved": ["users", "notices"], "requests": ["firms", "nv"], "convs": ["ns"], "raw_notices": ["notices"],
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the named views as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"
