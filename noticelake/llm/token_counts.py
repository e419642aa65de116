"""Token counts by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from noticelake.llm.common import pieces
from noticelake.llm.tokenizing import words_for

KEYS = ["source", "lang", "version"]


def counted(docs: DataFrame, tokenizers: list[str]) -> DataFrame:
    """``(doc_id, source, lang, n_tokens)`` of ``docs``: the ids of each whole text by the tokenizer files, in their order.

    Without special tokens. Null and empty texts have 0. Repeated rows stay; other columns are left out.
    """
    given = docs.select("doc_id", "source", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [words_for(path) for path in tokenizers]
        for batch in pieces(batches):
            ns = [[len(words.encode(t or "")) // 4 for words in each] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.list_(pa.int64()))], ["doc_id", "source", "lang", "n_tokens"])

    return given.mapInArrow(run, given.withColumn("n_tokens", F.array().cast("array<long>")).drop("text").schema)


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows ``(source, lang, version, docs, tokens)`` of a change log.

    ``changes(op, source, lang, version, n_tokens, old_source, old_lang, old_version, old_tokens)``:
    an ``insert`` adds its new values, a ``delete`` takes its old ones away, a ``revise`` does both. Other
    and null ops are ignored. Null keys are keys of their own, null counts are 0. Every row
    counts, repeated ones too.
    """
    part = lambda sign, pre, n: F.struct(
        *[F.col(f"{pre}{k}").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"),
        (F.lit(sign) * F.coalesce(F.col(n), F.lit(0))).cast("long").alias("tokens"),
    )
    new, old = part(1, "", "n_tokens"), part(-1, "old_", "old_tokens")
    parts = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new))
    return changes.select(F.explode(parts).alias("d")).select("d.*")


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Ledger:
    """Committed deltas in a folder, one subfolder for each batch, and rollups of them in a folder beside it.

    A batch is summed by key, written beside the ledger and renamed into place, so it is there in
    whole or not at all, and a batch id that is there already is left as it is: replays change nothing.
    A rollup has the totals of all batches so far and their ids, and comes into place likewise. One
    writer at a time.
    """

    KINDS = "source string, lang string, version string, docs long, tokens long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rolled = f"{self.path}-rolled"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _names(self, path: str, lead: str) -> list[int]:
        """The numbers of the subfolders ``<lead><number>``."""
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(path))] if self._there(path) else []
        return sorted(int(n.removeprefix(lead)) for n in found if n.startswith(lead))

    def _place(self, aside: str, to: str) -> bool:
        self._fs.mkdirs(self._path(to).getParent())
        if self._there(to) or not self._fs.rename(self._path(aside), self._path(to)):
            self._fs.delete(self._path(aside), True)
            return False
        return True

    def _generation(self, k: int, part: str) -> DataFrame:
        """The ``totals`` or ``batches`` of rollup ``k``; -1: of none."""
        kinds = self.KINDS.removesuffix(", batch long") if part == "totals" else "batch long"
        if k < 0:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.rolled}/generation-{k}/{part}")

    def _newest(self) -> int:
        return max(self._names(self.rolled, "generation-"), default=-1)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add the changes of ``batch``; False if it was committed before."""
        to = f"{self.path}/batch={batch}"
        if self._there(to) or not self._generation(self._newest(), "batches").where(F.col("batch") == batch).isEmpty():
            return False
        aside = f"{self.path}/_writing-{batch}-{uuid.uuid4().hex}"
        summed(signed(changes)).write.parquet(aside)
        return self._place(aside, to)

    def _since(self, k: int) -> DataFrame:
        """The deltas of batches that rollup ``k`` does not hold."""
        if not self._there(self.path):
            return self.spark.createDataFrame([], self.KINDS)
        return self.spark.read.schema(self.KINDS).parquet(self.path).join(self._generation(k, "batches"), "batch", "left_anti")

    def deltas(self) -> DataFrame:
        """All committed deltas by key; those of the newest rollup have a null ``batch``."""
        k = self._newest()
        return self._generation(k, "totals").withColumn("batch", F.lit(None).cast("long")).unionByName(self._since(k))

    def compact(self) -> None:
        """Roll all batches so far into one. Batches that the rollup before held are deleted, so who reads by that one still finds the rest."""
        old = self._newest()
        ids = self.spark.createDataFrame([(b,) for b in self._names(self.path, "batch=")], "batch long")
        aside = f"{self.rolled}/_writing-{uuid.uuid4().hex}"
        summed(self.deltas()).write.parquet(f"{aside}/totals")
        ids.unionByName(self._generation(old, "batches")).distinct().write.parquet(f"{aside}/batches")
        if not self._place(aside, f"{self.rolled}/generation-{old + 1}"):
            return
        for row in ids.join(self._generation(old, "batches"), "batch", "left_semi").collect():
            self._fs.delete(self._path(f"{self.path}/batch={row.batch}"), True)
        for k in self._names(self.rolled, "generation-"):
            if k < old:
                self._fs.delete(self._path(f"{self.rolled}/generation-{k}"), True)

    def totals(self) -> DataFrame:
        """``(source, lang, version, docs, tokens)`` over all committed batches; keys whose documents are all gone are left out."""
        return summed(self.deltas()).where("docs <> 0 OR tokens <> 0")
