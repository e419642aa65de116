"""Row rules: ranges, lengths and domains, as a table of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(c: str, low=None, high=None) -> Column:
    """True for null and for values inside the closed range."""
    ok = F.lit(True)
    ok = ok & (F.col(c) >= low) if low is not None else ok
    ok = ok & (F.col(c) <= high) if high is not None else ok
    return F.coalesce(ok, F.lit(True))


def length_in(c: str, low: int = 0, high: int | None = None, required: bool = False) -> Column:
    ok = F.length(c) >= low
    ok = ok & (F.length(c) <= high) if high is not None else ok
    return F.coalesce(ok, F.lit(not required))


def one_of(c: str, values: tuple, required: bool = False) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(not required))


# The rules of each kind of row.
RULES = {
    "search": {
        "query length": lambda: length_in("query", 3, required=True),
        "limit range": lambda: in_range("limit", 1, 50),
        "minimum value": lambda: in_range("min_value", 0),
        "maximum value": lambda: in_range("max_value", 0),
    },
    "profile": {
        "name length": lambda: length_in("company_name", 1, 255, required=True),
        "registration length": lambda: length_in("registration_number", 0, 50),
        "size": lambda: one_of("size", ("micro", "small", "medium", "large"), required=True),
        "founded year": lambda: in_range("founded_year", 1800, 2025),
    },
    "past_win": {
        "title length": lambda: length_in("contract_title", 0, 500, required=True),
        "buyer length": lambda: length_in("buyer_name", 0, 255, required=True),
        "value": lambda: in_range("contract_value", 0),
        "award date": lambda: F.col("award_date").isNotNull(),
    },
    "saved": {
        "title length": lambda: length_in("contract_title", 0, 500, required=True),
        "buyer length": lambda: length_in("buyer_name", 0, 255, required=True),
        "status": lambda: one_of("status", ("interested", "bidding", "won", "lost"), required=True),
        "notes length": lambda: length_in("notes", 0, 1000),
    },
    "email_settings": {
        "frequency": lambda: one_of("notification_frequency", ("daily", "weekly", "never")),
    },
    "notice": {
        "missing id": lambda: F.col("notice_id") != "UNKNOWN",
    },
}


def validate_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with ``broken_rules``, the names of the rules they break, evaluated in one pass."""
    broken = F.array(*[F.when(~rule(), F.lit(name)) for name, rule in RULES[kind].items()])
    return rows.withColumn("broken_rules", F.filter(broken, lambda r: r.isNotNull()))


def rejects(rows: DataFrame, kind: str) -> DataFrame:
    return validate_rows(rows, kind).where(F.size("broken_rules") > 0)


def rule_counts(rows: DataFrame, kind: str) -> DataFrame:
    """Rows breaking each rule."""
    return (
        validate_rows(rows, kind)
        .select(F.explode("broken_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
