"""Helpers shared by the training-data operators: reading, durable intermediates, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches are held to so many rows and bytes, so that neither an
    executor nor its Python workers hold thousands of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read. Taken from spark.checkpoint.dir; a temporary
    folder is made only when that is unset and the session is a single local JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ramus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ramus/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ramus_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete stored() tables that no later plan reads, and let Spark drop their shuffle files."""
    for df in frames:
        path = getattr(df, "_ramus_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)


def release(spark: SparkSession) -> None:
    """Unreferenced shuffles are dropped on a driver GC; asked for between large steps."""
    gc.collect()
    spark._jvm.System.gc()


#: A key is hot with more than this many rows and more than all rows / HOT_KEYS; so at most HOT_KEYS keys are.
LEAST_HOT, HOT_KEYS = 256, 4000


def hot_from(rows: int) -> int:
    return max(LEAST_HOT, rows // HOT_KEYS)


def dealt(rows: DataFrame, names: DataFrame, keys: list[str], weight: str, most: int, by: tuple[str, ...]) -> DataFrame:
    """rows joined with names, which holds each of the keys once and how many rows that has. Keys with more than
    `most` rows are dealt over several tasks by the columns `by`; such keys are few (all rows / most), so their
    list is broadcast."""
    parts = F.ceil(F.col(weight) / most).cast("int")
    hot = names.where(F.col(weight) > most).select(*keys, parts.alias("_parts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0)))
    copies = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.drop("_parts").join(copies, [*keys, "_salt"]).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for b in frames:
        if b.num_rows:
            yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) long pairs -> (id, comp): comp is the smallest id reachable.

    Minimum labels spread along edges and each round also jumps to the label's own
    label, so the rounds grow with the logarithm of the diameter. Everything stays in
    DataFrames; each round is stored, so lineage never grows. An empty input gives no rows.
    """
    spark = edges.sparkSession
    both = stored(
        edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct(), "cc-edges"
    )
    labels = stored(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("comp")), "cc")
    while True:
        # the label of my label, then the least label next to me
        near = (
            both.join(labels.select(F.col("id").alias("dst"), "comp"), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("comp").alias("m"))
        )
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = stored(step.join(up, "comp").select("id", "old", F.least("comp", "top").alias("comp")), "cc")
        moved = new.where("old <> comp").limit(1).count()
        forget(labels)
        labels = new
        if not moved:
            forget(both)
            return labels.select("id", "comp")
