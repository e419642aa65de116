"""Audit events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that are not audited, and the names given to the others.
SKIPPED_PATHS = ("/health", "/ready", "/docs", "/redoc", "/openapi.json", "/favicon.ico")
ACTIONS = (
    ("/auth/login", None, "user_login"),
    ("/auth/register", None, "user_register"),
    ("/documents/upload", None, "document_upload"),
    ("/documents", "DELETE", "document_delete"),
    ("/query", None, "query_executed"),
)
RESOURCES = (("/auth", "auth"), ("/documents", "document"), ("/query", "query"), ("/conversations", "conversation"))


def audit_action(method: str = "method", path: str = "path") -> Column:
    hits = [
        F.when(F.col(path).contains(part) & (F.lit(True) if verb is None else F.col(method) == verb), F.lit(name))
        for part, verb, name in ACTIONS
    ]
    other = F.concat(F.lower(method), F.lit("_"), F.element_at(F.split(path, "/"), -1))
    return F.coalesce(*hits, other)


def audit_resource(path: str = "path") -> Column:
    return F.coalesce(*[F.when(F.col(path).contains(part), F.lit(name)) for part, name in RESOURCES], F.lit("unknown"))


def audit_skip(events: DataFrame, path: str = "path") -> DataFrame:
    """Events on audited paths."""
    for prefix in SKIPPED_PATHS:
        events = events.where(~F.col(path).startswith(prefix))
    return events


def audit_details() -> Column:
    """Details of a request; latency in whole milliseconds, cut."""
    return F.struct(
        "method", "path", "status_code", (F.col("latency_seconds") * 1000).cast("int").alias("latency_ms"),
        F.col("user_id").cast("string").alias("user"),
    )


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows of request events. Works on a static table and on a stream alike."""
    return audit_skip(events).select(
        "event_id", "ts", "user_id", "firm_id",
        audit_action().alias("action"), audit_resource().alias("resource_type"), audit_details().alias("details"),
        F.coalesce("ip_address", F.lit("unknown")).alias("ip_address"), F.coalesce("user_agent", F.lit("")).alias("user_agent"),
    )


def conversation_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages per conversation, zero kept. Counting first keeps the join to one row per side."""
    counts = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"))
    joined = conversations.join(counts, "conversation_id", "left")
    return joined.withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def conversations_recent(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy("user_id", "firm_id", F.desc("updated_at"), "conversation_id")


def thread_messages(messages: DataFrame) -> DataFrame:
    return messages.orderBy("conversation_id", "timestamp", "message_id")
