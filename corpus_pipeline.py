"""A training corpus from raw documents: toxic ones go, one of each near-duplicate group stays, contaminated and similar ones go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticelake.llm import decontamination, near_dups, packing, similar_sets, toxicity
from noticelake.llm.common import ship, table
from noticelake.llm.token_files import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labels of ``docs``."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group linked by fingerprints 4 or fewer bits apart."""
    ship(spark)
    return near_dups.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in 13-word passages of ``benchmark``."""
    ship(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group linked by five-word Jaccard similarities of 0.8 or more, which fingerprints miss."""
    ship(spark)
    return similar_sets.without_similar(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("jaccard near-dedup", drop_similar),
    ("best-fit packing", pack_tokens),
]

#: Learned scores, 64-bit hashes and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
