"""Token ids in ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import cut, shared_dir
from noticelake.llm.tokenizing import words_for

#: ORC writer settings.
LAYOUT = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.compress": "ZLIB",
}


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``(block, row, doc_id, ids)`` of ``docs(doc_id, text)`` in ascending doc_id order.

    Blocks are ranges of doc_id; ``row`` counts within a block. The end id follows each text's ids.
    A null or empty text is its end id alone, null doc_ids come first, and repeated rows stay.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, block, at = words_for(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                ids = [words.encode(t or "") + end for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                flat = pa.array(np.frombuffer(b"".join(ids), np.uint32).astype(np.int32))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)],
                    ["block", "row", "doc_id", "ids"],
                )
                at += n

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, f"block int, row long, doc_id {kind}, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` to ORC files at ``path``; a failed task's files are never seen."""
    encoded(docs, tokenizer, end_id).write.options(**LAYOUT).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` only theirs, which stripes' indexes and Bloom filters prune."""
    rows = spark.read.schema("block int, row long, doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def positions(tokens: DataFrame) -> DataFrame:
    """Per written row: doc_id, the ids of all rows before it, its own count, and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["block", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = cut(
        tokens.select("block", "row", "doc_id", "ids")
        .mapInArrow(run, f"block int, row long, doc_id {kind}, n_tokens long, ids_crc32 long")
    )
    blocks = rows.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("row")) - F.col("n_tokens")
    return (
        rows.withColumn("within", within).join(blocks, "block")
        .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
