"""Row differences and three-way merges as single plans over tagged visible scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload(names: list[str], prefix: str) -> Column:
    """A row as canonical JSON (columns in name order), null where the row is absent."""
    return F.when(F.col(prefix).isNotNull(), F.to_json(F.struct(*[F.col(f"{prefix}.{n}").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"}))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these columns; those it lacks are null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names])


def row_diff(left: DataFrame, right: DataFrame, pk: list[str], table: str) -> DataFrame:
    """(table, key, change, before, after): what turns left into right.

    Columns are those of either side; a column that one side lacks compares as null.
    """
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    rest = [n for n in names if n not in pk]
    a = aligned(left, names).select(*pk, F.struct(*names).alias("b"))
    b = aligned(right, names).select(*[F.col(k).alias(f"_{k}") for k in pk], F.struct(*names).alias("a"))
    both = a.join(b, [F.col(k) == F.col(f"_{k}") for k in pk], "full_outer")
    differ = reduce(lambda x, y: x | y, [~same(F.col(f"b.{n}"), F.col(f"a.{n}")) for n in rest], F.lit(False))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(differ, "modified")
    key = F.to_json(F.struct(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in pk]))
    out = both.withColumn("change", change).where(F.col("change").isNotNull())
    return out.select(F.lit(table).alias("table"), key.alias("key"), "change", payload(names, "b").alias("before"), payload(names, "a").alias("after"))


def three_way(base: DataFrame, source: DataFrame, target: DataFrame, pk: list[str], agree: bool = False) -> DataFrame:
    """(pk..., b, s, t, outcome) for the keys that the source changed or both did.

    outcome is clean (target unchanged since base) or conflict (both sides changed it; equal values and double
    deletes too, unless these agree). The three scans are tagged and meet in one aggregate: one
    shuffle of the changed keys' rows, which Spark sorts, as the aggregate holds structs.
    """
    names = target.columns
    side = lambda df, tag: aligned(df, names).select(*pk, F.lit(tag).alias("_side"), F.struct(*names).alias("_r"))
    pick = lambda tag: F.first(F.when(F.col("_side") == tag, F.col("_r")), ignorenulls=True).alias(tag)
    rows = side(base, "b").unionByName(side(source, "s")).unionByName(side(target, "t"))
    got = rows.groupBy(*pk).agg(pick("b"), pick("s"), pick("t"))
    return got.withColumn("outcome", outcome(agree)).where(F.col("outcome").isNotNull())


def outcome(agree: bool = False) -> Column:
    """Truth table over states b, s, t: the first match wins."""
    st, sb, tb = same(F.col("s"), F.col("t")), same(F.col("s"), F.col("b")), same(F.col("t"), F.col("b"))
    return F.when(st & sb, F.lit(None)).when(st, F.lit(None) if agree else F.lit("conflict")).when(sb, F.lit(None)).when(tb, "clean").otherwise("conflict")


def change_kind(before: str, after: str) -> Column:
    return F.when(F.col(before).isNull() & F.col(after).isNotNull(), "added").when(F.col(before).isNotNull() & F.col(after).isNull(), "deleted").otherwise("modified")


def change_id(*parts: Column) -> Column:
    """Stable id of a change: the first 24 digits of a sha256 over its canonical JSON."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts]), 256), 1, 24)


def conflict_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts]))
