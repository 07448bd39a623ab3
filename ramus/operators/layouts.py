"""Other physical layouts of the same histories, each as a plan over DataFrames.

lineage tables are one row for each ancestor of a branch, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.sources.storage import fresh_root

#: Record ids of a version stand in lists of those that share all but their lowest bits.
LIST_BITS = 16


def lineage(spark, rows: list[tuple[str, int, int]]) -> DataFrame:
    """(branch, rank, upto): ancestors of a branch, rank growing towards it, and the last
    transaction of each that the branch sees."""
    return spark.createDataFrame(rows, "branch string, rank int, upto long")


def log_fold(log: DataFrame, path: DataFrame, pk: list[str]) -> DataFrame:
    """Rows of a branch from an operation log (branch, txn, log_id, op, columns...): the last
    operation of each key along the lineage, unless it is a delete. One shuffle; Spark sorts, as the
    aggregate holds structs."""
    names = [c for c in log.columns if c not in ("branch", "txn", "log_id", "op")]
    rest = [c for c in names if c not in pk]
    seen = log.join(F.broadcast(path), "branch").where("txn <= upto")
    last = seen.groupBy(*pk).agg(F.max_by(F.struct("op", *rest), F.struct("rank", "txn", "log_id")).alias("v"))
    return last.where("v.op <> 'delete'").select(*[c if c in pk else F.col(f"v.{c}").alias(c) for c in names])


def rlist_index(rids: DataFrame, vid: int) -> DataFrame:
    """(vid, part, rlist): the lists of a version's record ids (rid), none longer than 2 ** LIST_BITS."""
    return rids.groupBy(F.shiftright("rid", LIST_BITS).alias("part")).agg(F.sort_array(F.collect_list("rid")).alias("rlist")).select(F.lit(vid).cast("long").alias("vid"), "part", "rlist")


def rlist_ids(index: DataFrame, vid: int) -> DataFrame:
    return index.where(F.col("vid") == vid).select(F.explode("rlist").alias("rid"))


def rlist_scan(data: DataFrame, index: DataFrame, vid: int) -> DataFrame:
    """Rows of version vid, from records (rid, columns...) and lists (vid, part, rlist)."""
    return data.join(rlist_ids(index, vid), "rid", "left_semi").drop("rid")


def rlist_commit(data: DataFrame, index: DataFrame, parent: int, vid: int, changed: DataFrame, removed: DataFrame, pk: list[str], first_rid: int) -> tuple[DataFrame, DataFrame]:
    """(data, index) with a version vid: the parent's records without changed and removed keys,
    and new records for changed rows, numbered from first_rid on. New records are written before they
    are listed, so their numbers hold; each task numbers its own."""
    spark = data.sparkSession
    path = fresh_root(spark, "rlist")
    rid = (F.monotonically_increasing_id() + F.lit(first_rid)).cast("long").alias("rid")
    changed.select(rid, *[c for c in data.columns if c != "rid"]).write.parquet(path)
    new = spark.read.parquet(path)
    keys = changed.select(*pk).union(removed.select(*pk)).distinct()
    kept = data.join(rlist_ids(index, parent), "rid", "left_semi").join(keys, pk, "left_anti").select("rid")
    return data.unionByName(new), index.unionByName(rlist_index(kept.union(new.select("rid")), vid))


def rlist_delta(index: DataFrame, old: int, new: int) -> DataFrame:
    """(rid, change) of records that a version adds or drops against another, list by list."""
    side = lambda vid, name: index.where(F.col("vid") == vid).select("part", F.col("rlist").alias(name))
    none = F.array().cast("array<bigint>")
    lists = side(old, "a").join(side(new, "b"), "part", "full_outer").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = lists.select(F.array_except("a", "b").alias("gone"), F.array_except("b", "a").alias("more"))
    tag = lambda name, change: F.transform(name, lambda r: F.struct(r.alias("rid"), F.lit(change).alias("change")))
    return both.select(F.explode(F.concat(tag("gone", "removed"), tag("more", "added"))).alias("x")).select("x.rid", "x.change")


def rlist_ancestor(parents: dict[int, list[int]], left: int, right: int) -> int | None:
    """Nearest common version of two in a graph of versions: fewest steps in all, then from the
    left, then the smaller number. The graph is metadata, a few numbers for each version."""
    def steps(start: int) -> dict[int, int]:
        seen, edge = {start: 0}, [start]
        while edge:
            edge = [p for v in edge for p in parents.get(v, ()) if p > 0 and seen.setdefault(p, seen[v] + 1) == seen[v] + 1]
            edge = list(dict.fromkeys(edge))
        return seen

    a, b = steps(left), steps(right)
    return min(a.keys() & b.keys(), key=lambda v: (a[v] + b[v], a[v], v), default=None)


def rlist_reshape(data: DataFrame, index: DataFrame, vid: int, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(data, index) of a version whose columns change: records of its own under the same
    numbers, so that other versions keep theirs. build maps rows to rows and leaves rid alone."""
    ids = rlist_ids(index, vid)
    return build(data.join(ids, "rid", "left_semi")), index.where(F.col("vid") == vid)


def copy_branch(df: DataFrame, path: str) -> DataFrame:
    """A branch as a full copy; also what tests hold the other layouts against."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overlay(rows: DataFrame, path: DataFrame, pk: list[str]) -> DataFrame:
    """Rows of a branch from revisions (branch, revision, tombstone, columns...): nearest
    ancestor first, its newest revision up to the cutoff; tombstones hide. path: (branch, depth, cutoff)."""
    names = [c for c in rows.columns if c not in ("branch", "revision", "tombstone")]
    rest = [c for c in names if c not in pk]
    seen = rows.join(F.broadcast(path), "branch").where("revision <= cutoff")
    best = seen.groupBy(*pk).agg(F.min_by(F.struct("tombstone", *rest), F.struct("depth", -F.col("revision"))).alias("v"))
    return best.where("not v.tombstone").select(*[c if c in pk else F.col(f"v.{c}").alias(c) for c in names])


def overlay_changed_keys(rows: DataFrame, branch: str, lower: int, upper: int, pk: list[str]) -> DataFrame:
    """Keys with a revision in (lower, upper] on a branch."""
    return rows.where((F.col("branch") == branch) & (F.col("revision") > lower) & (F.col("revision") <= upper)).select(*pk).distinct()


def overlay_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """(branch, cutoff): the first ancestor of the left branch that the right one has too, up to the
    smaller of their cutoffs. left and right are paths (branch, depth, cutoff), a row for each ancestor."""
    both = left.join(F.broadcast(right.select("branch", F.col("cutoff").alias("_c"))), "branch")
    return both.orderBy("depth").limit(1).select("branch", F.least("cutoff", "_c").alias("cutoff"))


def not_superseded(points: DataFrame, path: DataFrame) -> DataFrame:
    """Points none of whose `overwritten_in` branches lies in the lineage."""
    mine = path.agg(F.collect_set("branch").alias("_l"))
    return points.crossJoin(F.broadcast(mine)).where(~F.arrays_overlap("overwritten_in", "_l") | F.col("overwritten_in").isNull() | (F.size("overwritten_in") == 0)).drop("_l")
