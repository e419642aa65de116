"""Uploaded files, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import strip

# What an upload may be.
UPLOAD_TYPES = ("pdf", "docx", "doc", "txt")
UPLOAD_MAX_BYTES = 10 * 1024 * 1024
STRICT_MAX_BYTES = 50 * 1024 * 1024
STRICT_MIN_CHARS = 10
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
}


def file_type(path: str = "path") -> Column:
    return F.lower(F.element_at(F.split(F.col(path), "[.]"), -1))


def screen_uploads(files: DataFrame) -> DataFrame:
    """Add ``file_type`` and ``reject_reason`` (null when accepted) from path and length."""
    kind = file_type()
    reason = (
        F.when(~kind.isin(*UPLOAD_TYPES), "unsupported type")
        .when(F.col("length") > UPLOAD_MAX_BYTES, "too large")
    )
    return files.withColumns({"file_type": kind, "reject_reason": reason})


def screen_by_mime(files: DataFrame) -> DataFrame:
    """The older rule: MIME list, 50 MiB, and at least ten characters of text."""
    kinds = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    kind = F.try_element_at(kinds, F.col("mime"))
    reason = (
        F.when(kind.isNull(), "unsupported type")
        .when(F.col("length") > STRICT_MAX_BYTES, "too large")
        .when(F.col("text").isNotNull() & (F.length(strip("text")) < STRICT_MIN_CHARS), "too short")
    )
    return files.withColumns({"file_type": kind, "reject_reason": reason})


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path``, one row each; plain text is decoded, other types keep their bytes.

    Rejected files have a ``reject_reason`` and null ``content`` and ``text``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Rejects are listed without their content; the length test is repeated so that it reaches the reader.
    rejected = screen_uploads(files.drop("content")).where("reject_reason is not null")
    accepted = screen_uploads(files.where(F.col("length") <= UPLOAD_MAX_BYTES)).where("reject_reason is null")
    text = F.when(F.col("file_type") == "txt", F.try_validate_utf8(F.col("content").cast("string")))
    return accepted.withColumn("text", text).unionByName(rejected, allowMissingColumns=True)


def sink_json_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sink_by_date(df: DataFrame, path: str, date: str = "ingest_date", mode: str = "append") -> None:
    """Parquet below one folder per day. Rows are clustered by day and hash, so that a day is
    written by several tasks and no task opens many folders."""
    spread = F.pmod(F.xxhash64("document_id"), F.lit(16))
    df.repartition(F.col(date), spread).write.mode(mode).partitionBy(date).parquet(path)
