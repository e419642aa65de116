"""Schemas of the relational tables and of the vector points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "users": "id string, email string, hashed_password string, full_name string, firm_id string, firm_name string, "
    "role string, is_active boolean, created_at timestamp, updated_at timestamp, "
    "email_notifications_enabled boolean, notification_frequency string, last_email_sent_at timestamp",
    "audit_logs": "id long, user_id string, firm_id string, action string, resource_type string, resource_id string, "
    "details map<string,string>, ip_address string, user_agent string, timestamp timestamp",
    "conversations": "id string, user_id string, firm_id string, title string, meta map<string,string>, "
    "created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, sources string, "
    "tokens_used int, latency_ms int, timestamp timestamp",
    "company_profiles": "id long, firm_id string, company_name string, registration_number string, size string, "
    "founded_year int, description string, onboarding_completed int, onboarding_step int, "
    "onboarding_completed_at timestamp, created_at timestamp, updated_at timestamp",
    "company_capabilities": "id long, company_id long, capability_text string, category string, "
    "years_experience int, qdrant_id string, created_at timestamp",
    "past_wins": "id long, company_id long, contract_title string, buyer_name string, contract_value decimal(15,2), "
    "award_date date, contract_duration_months int, description string, created_at timestamp",
    "search_preferences": "id long, company_id long, min_contract_value decimal(15,2), "
    "max_contract_value decimal(15,2), preferred_regions array<string>, excluded_categories array<string>, "
    "keywords array<string>, created_at timestamp",
    "saved_contracts": "id long, user_email string, firm_id string, notice_id string, contract_title string, "
    "buyer_name string, contract_value decimal(15,2), deadline timestamp, status string, notes string, "
    "saved_at timestamp, updated_at timestamp",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One relational table from Parquet, with its declared schema."""
    return spark.read.schema(schema(name)).parquet(f"{root.rstrip('/')}/{name}")


def point_row(df: DataFrame) -> DataFrame:
    """Defaults for the payload of a document chunk point."""
    return df.withColumns(
        {
            "page": F.coalesce("page", F.lit(1)),
            "document_id": F.coalesce("document_id", F.lit("")),
            "firm_id": F.coalesce("firm_id", F.lit("")),
        }
    )
