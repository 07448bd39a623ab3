"""Visible rows at a point, and compaction.

A write is appended with its interval [live_lo, live_hi) and a sequence number; the visible
version of a key at a point is the record with the highest number whose interval holds the
point, unless that is a tombstone. Commits are pruned on the driver by interval before a file is listed.
No commit holds a key twice, so one commit needs no aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ramus.plans.catalog import Catalog, Commit, Version

META = "live_lo long, live_hi long, writer_segment_id long, deleted boolean, seq long"
META_NAMES = [c.split()[0] for c in META.split(", ")]
#: Keys of a tail that are broadcast; commits record their row counts.
BROADCAST_ROWS = 500_000


def names_of(v: Version) -> list[str]:
    return StructType.fromDDL(v.ddl).fieldNames()


def at_point(point: int) -> Column:
    return (F.col("live_lo") <= F.lit(point)) & (F.col("live_hi") > F.lit(point))


def records(spark: SparkSession, v: Version, commits: list[Commit], cut: bool = False) -> DataFrame:
    """All version rows of some commits. Commits with the same added columns are read by one scan.
    cut: rows of shared commits lose what lies outside of the commit; a read at a point needs no cutting."""
    names = names_of(v)
    alike: dict[tuple, list[Commit]] = {}
    for c in commits:
        own = (c.path, c.lo, c.hi) if c.adopted or (cut and c.shared) else ()
        alike.setdefault((tuple(sorted(c.fill.items())), *own), []).append(c)
    out = None
    for same in alike.values():
        c = same[0]
        held = StructType([f for f in StructType.fromDDL(v.ddl) if f.name not in c.fill])
        if c.adopted:
            values = (c.lo, c.hi, c.writer, False, c.seq)
            one = spark.read.schema(held).parquet(c.path).select("*", *[F.lit(x).cast(n.split()[1]).alias(n.split()[0]) for x, n in zip(values, META.split(", "))])
        else:
            one = spark.read.schema(StructType([*held, *StructType.fromDDL(META)])).parquet(*[x.path for x in same])
            if cut and c.shared:
                one = one.withColumns({"live_lo": F.greatest("live_lo", F.lit(c.lo)), "live_hi": F.least("live_hi", F.lit(c.hi))}).where("live_lo < live_hi")
        one = one.select(*[F.expr(c.fill[n]).alias(n) if n in c.fill else F.col(f"`{n}`") for n in names], *META_NAMES)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"{v.ddl}, {META}") if out is None else out


def latest(rows: DataFrame, pk: list[str], names: list[str], few: bool = False) -> DataFrame:
    """The newest record of each key, tombstones included. Few rows: a hash aggregate of keys and
    numbers, which is broadcast to the rows. Otherwise one shuffle of the rows, whose structs Spark
    aggregates by sorting."""
    if few:
        top = rows.groupBy(*pk).agg(F.max("seq").alias("seq"))
        return rows.join(F.broadcast(top), [*pk, "seq"], "left_semi").select(*names, "deleted", "writer_segment_id")
    rest = [n for n in names if n not in pk]
    top = F.max_by(F.struct(*rest, "deleted", "writer_segment_id"), "seq").alias("_v")
    got = rows.groupBy(*pk).agg(top)
    return got.select(*pk, *[F.col(f"_v.{n}").alias(n) for n in [*rest, "deleted", "writer_segment_id"]])


def resolved(spark: SparkSession, catalog: Catalog, v: Version, point: int, pending: list[Commit] = ()) -> DataFrame:
    """Visible rows with their writer."""
    here = [c for c in [*catalog.commits, *pending] if c.version == v.id and c.lo <= point < c.hi]
    base, tail = [c for c in here if c.base], [c for c in here if not c.base]
    names = names_of(v)
    keep = [*names, "writer_segment_id"]
    bottom = records(spark, v, base).where(at_point(point) & ~F.col("deleted"))
    if not tail:
        return bottom.select(*keep)
    few = sum(c.rows for c in tail) <= BROADCAST_ROWS
    top = records(spark, v, tail).where(at_point(point))
    top = latest(top, v.pk, names, few) if len(tail) > 1 else top
    if not base:
        return top.where(~F.col("deleted")).select(*keep)
    keys = top.select(*v.pk)
    below = bottom.join(F.broadcast(keys) if few else keys, v.pk, "left_anti")
    return below.select(*keep).unionByName(top.where(~F.col("deleted")).select(*keep))


def visible(spark: SparkSession, catalog: Catalog, v: Version, point: int, pending: list[Commit] = ()) -> DataFrame:
    """The table as a query at this point sees it."""
    return resolved(spark, catalog, v, point, pending).drop("writer_segment_id")


def by_keys(rows: DataFrame, keys: DataFrame, pk: list[str], few: bool) -> DataFrame:
    """Rows whose key is among keys; keys are broadcast where their count is known to be small."""
    return rows.join(F.broadcast(keys) if few else keys, pk, "left_semi")


def spliced(spark: SparkSession, v: Version, commits: list[Commit], dead: set[int]) -> DataFrame:
    """The same versions with non-overlapping intervals and no tombstones, dead writers left out.

    Every key's intervals are cut at all of their ends; of each piece the newest record covering
    it stays. Only the versions of one key come together, in one array.
    """
    names = names_of(v)
    rows = records(spark, v, commits, cut=True)
    if dead:
        rows = rows.where(~F.col("writer_segment_id").isin([int(x) for x in dead]))
    rest = [n for n in names if n not in v.pk]
    one = F.struct("seq", "live_lo", "live_hi", "deleted", "writer_segment_id", *rest)
    got = rows.groupBy(*v.pk).agg(F.collect_list(one).alias("r"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("r", lambda x: x.live_lo), F.transform("r", lambda x: x.live_hi))))
    got = got.withColumn("e", ends).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("e") - 1)))
    got = got.withColumn("lo", F.element_at("e", F.col("i"))).withColumn("hi", F.element_at("e", F.col("i") + 1))
    # compare by seq alone: values need not be orderable
    over = F.filter("r", lambda x: (x.live_lo <= F.col("lo")) & (x.live_hi >= F.col("hi")))
    got = got.withColumn("o", over).where(F.size("o") > 0)
    top = F.array_max(F.transform("o", lambda x: x.seq))
    got = got.withColumn("m", top).withColumn("w", F.element_at(F.filter("o", lambda x: x.seq == F.col("m")), 1)).where(~F.col("w.deleted"))
    return got.select(
        *[F.col(n) if n in v.pk else F.col(f"w.{n}").alias(n) for n in names],
        F.col("lo").alias("live_lo"), F.col("hi").alias("live_hi"), F.col("w.writer_segment_id").alias("writer_segment_id"),
        F.lit(False).alias("deleted"), F.col("w.seq").alias("seq"),
    )
