"""Mixing sources to target weights by weighted fair queueing.

Each source holds its documents in a shuffled order, up to EPOCHS times over. An item's virtual
finish time is the source's tokens up to and with it, divided by the source's target; an item is
eligible while its virtual start lies before 1. All eligible items are range-sorted by finish
time and the sequence is cut where the total budget is reached.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Fewest documents in a bucket of a source; large sources have about as many buckets as documents in each.
BUCKET_DOCS = 128


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, epochs: int = EPOCHS) -> dict[str | None, Fraction]:
    """Shares of the total size by weight, at most epochs times a source's size; what a
    source can't take goes to the others by weight until no target is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, out = Fraction(sum(sizes.values())), list(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        over = [s for s in active if weight[s] * level > epochs * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in active}
        for s in over:
            out[s] = Fraction(epochs * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


def take(base: DataFrame) -> DataFrame:
    """base (rid, doc_id, source, size), stored -> base with source_size, target, copies.

    The table of sources (a name and a size each) is the only thing that reaches the driver.
    """
    spark = base.sparkSession
    per = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    goal = targets({r.source: r.s for r in per})
    info = spark.createDataFrame(
        [(r.source, r.s, float(goal[r.source]), -(-r.n // max(BUCKET_DOCS, int(r.n**0.5)))) for r in per],
        "source string, source_size long, target double, n_buckets long",
    ).withColumnRenamed("source", "src")
    budget = sum(r.s for r in per)
    named = base.join(F.broadcast(info) if len(per) < 10_000 else info, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # md5 prefixes are uniform, so equal ranges of them are equal buckets
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = named.withColumn("key", key).withColumn("bucket", F.floor(prefix * F.col("n_buckets") / F.lit(float(1 << 32))).cast("long"))
    total = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    cum = keyed.withColumn("cum", F.sum("size").over(inside)).join(
        offset, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    )
    end = F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("cum")
    items = (
        cum.where("size > 0 and target > 0")
        .select("rid", "source", "key", "size", "target", F.explode(F.array(*[F.lit(i) for i in range(EPOCHS)])).alias("epoch"), "source_size", "offset", "cum")
        .where(end - F.col("size") < F.col("target"))
        .select("rid", "source", "key", "size", "epoch", (end / F.col("target")).alias("finish"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = stored(items.repartitionByRange(parts, "finish", "source", "key").withColumn("part", F.spark_partition_id()), "mix-line")
    at, crossing = 0, -1
    for part, n in line.groupBy("part").agg(F.sum("size")).orderBy("part").collect():  # a row for each partition
        if at + n > budget:
            crossing = part
            break
        at += n
    whole = line if crossing < 0 else line.where(F.col("part") < crossing)
    run = Window.partitionBy("part").orderBy("finish", "source", "key", "epoch", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    edge = line.where(F.col("part") == crossing).withColumn("run", F.sum("size").over(run)).where(F.col("run") + at <= budget)
    copies = whole.select("rid").union(edge.select("rid")).groupBy("rid").agg(F.count("*").alias("copies"))
    return named.join(copies, "rid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source).

    A null text has size 0 and is never taken; a null source is a source of its own, last in
    order. Repeated rows are documents of their own. Ties of the shuffled order (repeated ids)
    go by size, equal finish times by source, shuffled order and epoch; a very long text counts whole. An empty table gives no rows; other columns are ignored. Reruns agree, as the
    order depends on ids and sizes alone.
    """
    base = stored(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size")),
        "mix-base",
    )
    return take(base).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; columns unchanged, whatever their names.
    Cases as in mix()."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text, source = (F.col(names[docs.columns.index(n)]) for n in ("doc_id", "text", "source"))
    kept = stored(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "mix-docs")
    base = stored(kept.select("rid", doc_id.alias("doc_id"), source.cast("string").alias("source"), word_count(text.cast("string")).alias("size")), "mix-base")
    copies = take(base).where("copies > 0").select("rid", "copies")
    again = kept.join(copies, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(c).alias(n) for c, n in zip(names, docs.columns)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
