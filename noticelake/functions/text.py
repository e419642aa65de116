"""Column expressions for cleaning and parsing text fields.

All are built-in expressions, so they stay inside the JVM and push into scans where possible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when trimming or splitting, as a pattern and one by one.
WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` refers to it.

    Plain column expressions are trees: a value used five times is written out five times, and again
    wherever a filter on the result is pushed down.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c) -> Column:
    """Trim every kind of white space (``trim`` alone would only drop spaces); a pattern would try every character."""
    return F.btrim(col(c), F.lit(SPACES))


def blank(c) -> Column:
    """True for null and for text of white space only."""
    return col(c).isNull() | (strip(c) == "")


def squeeze(c) -> Column:
    """Trim and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def clean_field(c) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def words(c) -> Column:
    """Words of a text; an empty array for blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def parse_money(c) -> Column:
    """``£1,234.50`` to double; null for blanks, text and non-finite numbers."""
    number = strip(F.translate(col(c), "£,", "")).try_cast("double")
    # NaN sorts above infinity, so one comparison rules out both.
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_list(c) -> Column:
    """Codes separated by ``;`` or ``,``; blanks dropped, null becomes an empty array."""
    parts = F.transform(F.split(F.translate(col(c), ";", ","), ","), strip)
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


# Accepted spellings of yes and no.
TRUE_WORDS = ("yes", "true", "1", "y")
FALSE_WORDS = ("no", "false", "0", "n")


def parse_bool(c) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def join_parts(*parts) -> Column:
    """Non-blank parts, trimmed and joined by a comma; null when none is left."""
    kept = F.filter(F.array(*[strip(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def pick_value(low, high) -> Column:
    """The low value unless it is missing or zero."""
    return F.when(col(low) != 0, col(low)).otherwise(col(high))


_ISO = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)([+-][0-9]{2}:[0-9]{2})?)?$"
)
_OFFSET = r"[+-][0-9]{2}:[0-9]{2}$"
# The other formats a date may have, tried in this order. The first pattern of each
# pair says what the text has to look like, the second how it is read.
_PLAIN_FORMATS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "d/M/yyyy H:m:s"),
)


def _iso_timestamp(text: Column) -> Column:
    """ISO text to timestamp; without an offset it is read as UTC."""
    # The cast wants seconds, and a zone whatever the session's is.
    timed = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(
        F.regexp_replace(text, r"^(.{10}[T ][0-9]{2}:[0-9]{2})($|[+-])", "$1:00$2")
    )
    whole = F.concat(timed, F.when(text.rlike(_OFFSET), "").otherwise("+00:00"))
    return F.when(text.rlike(_ISO), whole.try_cast("timestamp"))


def _stamped(ts: Column, naive: Column) -> Column:
    return F.struct(ts.alias("ts"), F.coalesce(ts.isNotNull() & naive, F.lit(False)).alias("is_naive"))


def parse_notice_date(c) -> Column:
    """Struct ``(ts, is_naive)`` of a notice date text.

    ``is_naive`` marks an ISO time without an offset; whether such a value may be compared
    with ``as_of`` is the caller's choice.
    """

    def read(text: Column) -> Column:
        colons = F.length(text) - F.length(F.translate(text, ":", ""))
        as_iso = text.endswith("Z") | (text.contains("T") & (text.contains("+") | (colons >= 2)))
        iso = F.when(as_iso, _iso_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))
        plain = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in _PLAIN_FORMATS]
        naive = as_iso & ~text.endswith("Z") & ~text.rlike(_OFFSET)
        return let(F.coalesce(iso, *plain), lambda ts: _stamped(ts, naive))

    return let(strip(c), read)


def parse_iso(c) -> Column:
    """Struct ``(ts, is_naive)`` of an ISO text with or without an offset."""
    zoned = F.replace(col(c), F.lit("Z"), F.lit("+00:00"))
    return let(zoned, lambda text: _stamped(_iso_timestamp(text), ~text.rlike(_OFFSET)))


def md5_uuid(c) -> Column:
    return F.regexp_replace(F.md5(col(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def firm_slug(c) -> Column:
    return F.concat(F.lit("firm-"), F.translate(F.lower(col(c)), " _", "--"))


def document_id(user, text) -> Column:
    return F.concat(F.lit("user_"), col(user).cast("string"), F.lit("_doc_"), F.substring(F.md5(col(text)), 1, 12))


def preview(c) -> Column:
    """First 200 characters and an ellipsis, empty text for none."""
    return F.when(F.length(col(c)) > 0, F.concat(F.substring(col(c), 1, 200), F.lit("..."))).otherwise("")


def notice_url(c, base: str) -> Column:
    return F.when(F.length(col(c)) > 0, F.concat(F.lit(base), col(c))).otherwise("")


def tender_id(url) -> Column:
    after = F.element_at(F.split(col(url), "/Notice/"), -1)
    return F.element_at(F.split(after, r"\?"), 1)


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


# Keywords looked up in a file name, in order, with the document type each stands for.
FILE_KEYWORDS = {
    "contract": "contract",
    "agreement": "agreement",
    "policy": "policy",
    "employment": "employment_contract",
    "nda": "non_disclosure_agreement",
    "lease": "commercial_lease",
    "terms": "terms_and_conditions",
}
CASE_ID = r"([A-Z]{2,4}-[0-9]{4}-[0-9]{3})"


def case_id(filename) -> Column:
    return F.nullif(F.regexp_extract(col(filename), CASE_ID, 1), F.lit(""))


def file_document_type(filename) -> Column:
    name = F.lower(col(filename))
    hits = [F.when(name.contains(word), F.lit(kind)) for word, kind in FILE_KEYWORDS.items()]
    return F.coalesce(*hits)


def filename_metadata(filename, user_metadata=None) -> Column:
    """Map of what a file name says about a document; entries given by the user win."""
    found = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("filename").alias("k"), col(filename).alias("v")),
                F.struct(F.lit("case_id").alias("k"), case_id(filename).alias("v")),
                F.struct(F.lit("document_type").alias("k"), file_document_type(filename).alias("v")),
            ),
            lambda e: e["v"].isNotNull(),
        )
    )
    if user_metadata is None:
        return found
    given = F.coalesce(col(user_metadata), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(found, lambda k, v: ~F.map_contains_key(given, k)), given)
