"""From raw documents to token files: five stages over the documents table.

Each stage works on all that the one before it kept; all but the last return the columns of
documents. run() writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ramus.llm import language_id, mixing
from ramus.llm.common import bounded_batches, forget, fresh_path, table
from ramus.llm.decontamination import decontaminated
from ramus.llm.minhash_dedup import deduplicated
from ramus.llm.token_output import token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told."""
    bounded_batches(spark)
    return language_id.known_language(docs, language_id.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    bounded_batches(spark)
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    bounded_batches(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold: doc_id, start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    return token_output(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token-ID output", tokens),
]
#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._ramus_path = path
        if before is not None:  # the next stage reads only this one's table
            forget(before)
        before = docs
    return docs
