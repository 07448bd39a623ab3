"""Sources that tables are registered from."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A question of a retrieval benchmark.
QUESTIONS = "question_id string, question string, expected_doc_ids array<string>, question_type string, source_types array<string>, gold_answer string"


def read_url(spark: SparkSession, url: str, table: str | None = None, **options) -> DataFrame:
    """A table by url: parquet, orc, json, csv by ending, or jdbc: with a table name."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    kind = urlparse(url).path.rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "ndjson": "json", "tsv": "csv"}.get(kind, kind)
    if kind not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"no reader for {url}")
    if kind == "csv":
        options = {"header": "true", "sep": "\t" if url.endswith(".tsv") else ","} | options
    return spark.read.format(kind).options(**options).load(url)


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(QUESTIONS).json(path)
    return df.limit(limit) if limit else df


def read_objects(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """An object map (bucket, object_key, physical, size, etag) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    key = F.element_at(F.split(F.col("path"), F.lit(base + "/"), 2), 2)
    return files.select(F.lit(bucket).alias("bucket"), key.alias("object_key"), F.col("path").alias("physical"), F.col("length").alias("size"), F.md5("content").alias("etag"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text and JSON files, JSON rendered as `name: value` lines in name order."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    fields = F.from_json("text", "map<string,string>")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return files.select("path", F.when(F.col("path").endswith(".json"), lines).otherwise(F.col("text")).alias("text"))
