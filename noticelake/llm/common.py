"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
PACKAGE = pathlib.Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A single-JVM session without one gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="noticelake-llm-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later steps survive lost executors without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which need not share this process's path.

    Rows go to the workers in batches of ``BATCH_ROWS`` at most, closed once they hold ``BATCH_BYTES``, as whole texts are long rows.
    """
    sc = spark.sparkContext
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if not 0 < int(held) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not size.isdecimal() or int(size) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_noticelake_llm_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="noticelake-ship-"), "noticelake_llm.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._noticelake_llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def pieces(batches, rows: int = 512):
    """Arrow batches in slices of a few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
