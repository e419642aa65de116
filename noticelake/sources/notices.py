"""Reading notices: CSV exports, OCDS release packages and saved web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.sources import splitting

# The column headings of the notices CSV.
CSV_COLUMNS = (
    "Notice Identifier", "Title", "Organisation Name", "Description", "Region", "Postcode",
    "Notice Type", "Closing Time", "Status", "Published Date", "Closing Date", "Start Date",
    "End Date", "Value Low", "Value High", "Cpv Codes", "Suitable for SME", "Suitable for VCO",
    "Contact Address 1", "Contact Address 2", "Contact Town", "Contact Postcode", "Contact Country",
    "Contact Name", "Contact Email", "Contact Telephone", "Contact Website",
    "Additional Text", "Attachments", "Links",
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_ADDRESS = T.StructType(_strings("region"))
_ITEM = T.StructType([T.StructField("classification", T.StructType(_strings("scheme", "id")))])
_TENDER = T.StructType(
    _strings("title", "description", "status")
    + [
        T.StructField("tenderPeriod", T.StructType(_strings("endDate"))),
        T.StructField("value", T.StructType(_strings("amount"))),
        T.StructField("items", T.ArrayType(_ITEM)),
        T.StructField("deliveryAddresses", T.ArrayType(_ADDRESS)),
    ]
)
RELEASE = T.StructType(
    _strings("id", "date")
    + [T.StructField("buyer", T.StructType(_strings("name"))), T.StructField("tender", _TENDER)]
)
# One schema for both file shapes: a package with ``releases``, or an array of bare releases.
PACKAGE = T.StructType([T.StructField("releases", T.ArrayType(RELEASE)), *RELEASE.fields])


def scan_notices_csv(
    spark: SparkSession, path: str, headers: list[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """Headed CSV with quoted multi-line cells; every column arrives as text.

    Large files are read by many tasks, multi-line cells or not (see :func:`splitting.quoted_records`);
    with ``multi_line=False``, for files known to have no such cells, Spark's own reader is used, which
    needs one pass less.

    Columns are mapped by position, so pass the file's ``headers`` when they are not in the usual
    order; a file whose first row differs from them is an error. Columns a file lacks come back null.
    """
    names = list(headers or CSV_COLUMNS)
    schema = T.StructType(_strings(*names))
    if multi_line:
        raw = _split_csv(spark, path, schema)
    else:
        raw = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("escape", '"').option("encoding", "UTF-8").csv(path)
        )
    return raw.select(*[F.col(f"`{n}`") if n in names else F.lit(None).cast("string").alias(n) for n in CSV_COLUMNS])


def _split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # multiLine keeps line ends within quotes as they are.
    parse = lambda c: F.from_csv(c, _ddl(schema), {"escape": '"', "multiLine": "true"})
    records = splitting.quoted_records(spark, path).withColumn("record", splitting.without_line_end("record")).where(F.trim("record") != "")
    first = (F.col("block") == 0) & (F.col("place") == 0)
    said = parse(F.regexp_replace("record", "^\uFEFF", ""))
    right = F.array(*[F.lower(F.coalesce(said[f.name], F.lit(""))) for f in schema.fields]) == F.array(*[F.lit(f.name.lower()) for f in schema.fields])
    wrong = F.raise_error(F.concat(F.lit("unexpected CSV header in "), "file"))
    return records.where(F.when(~first, True).when(right, False).otherwise(wrong.cast("boolean"))).select(parse("record").alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema.fields)


def releases(packages: DataFrame) -> DataFrame:
    """Packages, or bare releases, to one row per release."""
    listed = F.when(F.col("releases").isNotNull(), F.col("releases")).otherwise(
        F.array(F.struct(*[F.col(f.name) for f in RELEASE.fields]))
    )
    return packages.select(F.inline(listed))


def scan_ocds_json(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """All release files below ``path`` as one table of releases (pages concatenate by being read).

    A file holds one package or array, which many tasks read (see :func:`splitting.json_records`), or with
    ``one_per_line`` one per line, which Spark's reader splits itself.
    """
    if one_per_line:
        return releases(spark.read.schema(PACKAGE).json(path))
    return parse_packages(splitting.json_records(spark, path), "record")


def parse_packages(df: DataFrame, text: str = "body") -> DataFrame:
    """Release packages held as JSON text in a column."""
    return releases(df.select(F.from_json(text, PACKAGE).alias("p")).select("p.*"))
