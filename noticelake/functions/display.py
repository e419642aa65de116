"""Column expressions for texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import col, strip

# Fixed value: length of the text handed to an embedding provider.
EMBEDDING_TEXT_CHARS = 2000


def money(v, digits: int = 0) -> Column:
    return F.concat(F.lit("£"), F.format_number(col(v).cast("double"), digits))


def format_value(v) -> Column:
    """A number or numeric text as pounds; other text stays as it is."""
    value = col(v)
    return F.when(value.isNull(), "Not specified").otherwise(
        F.coalesce(money(value.cast("string").try_cast("double")), value.cast("string"))
    )


def format_deadline(ts) -> Column:
    return F.when(col(ts).isNull(), "Not specified").otherwise(F.date_format(col(ts), "dd MMMM yyyy"))


def percent(score) -> Column:
    """Whole percent, cut rather than rounded."""
    return F.coalesce((col(score) * 100).cast("int"), F.lit(0))


def percent_text(score) -> Column:
    """Whole percent, rounded half to even."""
    return F.concat(F.format_number(col(score) * 100, 0), F.lit("%"))


def display_text(n: dict | None = None) -> Column:
    """The labelled eight-line text stored with a notice."""
    c = lambda name: F.col((n or {}).get(name, name))
    filled = lambda name, fallback: F.when(F.length(c(name)) > 0, c(name)).otherwise(fallback)
    codes = F.when(F.size(c("cpv_codes")) > 0, F.array_join(c("cpv_codes"), ", ")).otherwise("None")
    value = F.when(c("value").isNull(), "Not specified").otherwise(money(c("value"), 2))
    closing = F.coalesce(F.date_format(c("closing_date"), "yyyy-MM-dd"), F.lit("Not specified"))
    lines = [
        ("Title", c("title")),
        ("Description", filled("description", "No description")),
        ("Buyer", c("buyer_name")),
        ("Value", value),
        ("CPV Codes", codes),
        ("Region", filled("region", "Not specified")),
        ("Closing Date", closing),
        ("Additional Info", filled("additional_text", "None")),
    ]
    return strip(F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), text) for label, text in lines]))


def embedding_text(title="title", description="description") -> Column:
    both = strip(F.concat(col(title), F.lit("\n\n"), F.coalesce(col(description), F.lit(""))))
    for end in ("\r\n", "\r", "\n"):
        both = F.replace(both, F.lit(end), F.lit(" "))
    return F.substring(both, 1, EMBEDDING_TEXT_CHARS)


def digest_subject(total) -> Column:
    return F.concat(F.lit("🎯 "), col(total).cast("string"), F.lit(" new contracts match your profile"))


def reminder_subject(days, title) -> Column:
    mark = F.when(col(days) == 1, "🚨").otherwise("⏰")
    plural = F.when(col(days) > 1, "s").otherwise("")
    return F.concat(
        mark, F.lit(" Deadline in "), col(days).cast("string"), F.lit(" day"), plural, F.lit(": "),
        F.substring(col(title), 1, 50), F.lit("..."),
    )


def urgency_band(days) -> Column:
    return F.when(col(days) == 1, "urgent").when(col(days) == 3, "soon").otherwise("notice")


def urgency_text(days) -> Column:
    return (
        F.when(col(days) == 1, "URGENT: Deadline Tomorrow!")
        .when(col(days) == 3, "Deadline in 3 Days")
        .otherwise(F.concat(F.lit("Deadline in "), col(days).cast("string"), F.lit(" Days")))
    )


def is_new(published, as_of) -> Column:
    """Published at most seven whole days before ``as_of``; a future date counts as new."""
    age = F.floor((F.unix_micros(col(as_of)) - F.unix_micros(col(published))) / F.lit(86_400_000_000))
    return F.coalesce(age <= 7, F.lit(False))
