"""Procurement-notice ingest, vector search, match scoring and feeds as Spark DataFrame jobs."""
