"""Branchable tables: a store, its branch sessions, and merges.

Every write is one append of a DataFrame plus one published catalog version. Nothing is
rewritten in place; compact() replaces many commits by one spliced base. Publishing is a compare-and-swap:
a writer that loses the race looks at the newer catalog, and goes on only if what it read still holds.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ramus.operators import diff as D
from ramus.operators import scan as S
from ramus.plans import sqlfront
from ramus.plans.allocator import Allocator
from ramus.plans.catalog import BranchError, Catalog, Commit, Segment, Version
from ramus.sources.storage import CommitConflict, JsonVersions, StoreLog, fresh_root


class DuplicateKeyError(BranchError):
    pass


class TableNotRegisteredError(BranchError):
    pass


class ReadOnlyError(BranchError):
    pass


class MergeConflictError(BranchError):
    pass


class StalePreviewError(BranchError):
    pass


POLICIES = ("abort_on_conflict", "snapshot_isolation", "weak_snapshot_isolation", "source_wins", "target_wins", "manual_review", "custom")
#: Attempts to publish, and seconds that a loser waits at most per attempt so far.
RETRIES, PAUSE = 24, 0.02
#: A lease that began so long before the newest is of a crashed holder.
LEASE_SECONDS = 7 * 86_400
#: Types whose literals mean the same in every session.
PLAIN = ("byte", "short", "integer", "long", "float", "double", "decimal", "string", "boolean", "date", "void")


class BranchStore:
    """Tables under one root folder, shared by all branches."""

    def __init__(self, spark: SparkSession, root: str | None = None, allocator: Allocator | None = None, log: StoreLog | None = None):
        self.spark = spark
        self.root = root or fresh_root(spark)
        self.allocator = allocator or Allocator()
        self.log = log or JsonVersions(spark, f"{self.root}/catalog")
        self.catalog, self.at = Catalog.new(), -1
        for attempt in range(RETRIES):
            at = self.log.latest()
            found = self.log.read(at) if at >= 0 else None
            if found is not None:
                self.catalog, self.at = Catalog.from_json(found), at
                break
            try:
                self.log.publish(at + 1, self.catalog.to_json())
            except CommitConflict:  # another writer founded the store, or another store of a shared log wrote
                self._lost(attempt)
                continue
            self.at = at + 1
            break

    # -- metadata ----------------------------------------------------------------------------------
    def refresh(self) -> None:
        at = self.log.latest(self.at)
        if at != self.at:
            self.catalog, self.at = Catalog.from_json(self.log.read(at)), at

    @staticmethod
    def _lost(attempt: int) -> None:
        if attempt + 1 >= RETRIES:
            raise CommitConflict("other writers were first, again and again")
        time.sleep(random.random() * PAUSE * (attempt + 1))

    def discard(self, draft: Catalog, base: Catalog) -> None:
        """Delete what a draft wrote that wasn't published."""
        known = {c.path for c in base.commits}
        for c in draft.commits:
            if c.path not in known and c.path.startswith(f"{self.root}/data/"):
                self.log.delete(c.path)

    def publish(self, change: Callable[[Catalog], object]):
        """Apply change to the newest catalog and publish it; another writer's version is read
        and the change tried again. Data of a lost attempt, or of one that raises, is deleted. If change
        writes data, a lease must keep that from vacuum()."""
        for attempt in range(RETRIES):
            self.refresh()
            new, base = self.catalog.copy(), self.catalog
            try:
                got = change(new)
                self.log.publish(self.at + 1, new.to_json())
            except CommitConflict:
                self.discard(new, base)
                self._lost(attempt)
                continue
            except Exception:
                self.discard(new, base)
                raise
            self.catalog, self.at = new, self.at + 1
            return got

    def create_branch(self, name: str, source: str = "main", **how):
        return self.publish(lambda c: c.fork(name, source, self.allocator, **how))

    def create_checkpoint(self, name: str, branch: str = "main", metadata: dict | None = None):
        return self.publish(lambda c: c.checkpoint(name, branch, self.allocator, metadata))

    def create_branch_from_checkpoint(self, name: str, checkpoint: str, metadata: dict | None = None):
        return self.publish(lambda c: c.fork_checkpoint(name, checkpoint, self.allocator, metadata))

    def delete_branch(self, name: str) -> list[str]:
        return self.publish(lambda c: c.delete(name))

    def update_branch_metadata(self, name: str, metadata: dict) -> None:
        self.publish(lambda c: c.branch(name).metadata.update(metadata))

    def list_branches(self, **metadata) -> DataFrame:
        rows = [(b.id, b.parent, b.kind, b.children, b.current) for b in self.catalog.branches.values() if metadata.items() <= b.metadata.items()]
        return self.spark.createDataFrame(rows, "branch string, parent string, kind string, child_count int, segment long")

    def list_checkpoints(self, **metadata) -> DataFrame:
        rows = [(c.id, c.branch, c.segment) for c in self.catalog.checkpoints.values() if metadata.items() <= c.metadata.items()]
        return self.spark.createDataFrame(rows, "checkpoint string, branch string, segment long")

    # -- tables ------------------------------------------------------------------------------------
    def _registering(self, name: str, df: DataFrame, pk: list[str], verify: bool, agree: bool, defaults: dict[str, str] | None, load: Callable) -> None:
        if not pk:
            raise BranchError(f"{name} needs a primary key")
        if verify:
            bad = df.groupBy(*pk).count().where((F.col("count") > 1) | F.greatest(*[F.col(k).isNull() for k in pk], F.lit(False)))
            if bad.limit(1).count():
                raise DuplicateKeyError(f"{name}: {pk} is null or not unique")
        ddl = df.schema.toDDL().replace(" NOT NULL", "")

        def change(c: Catalog):
            if name in c.tables:
                raise BranchError(f"table already registered: {name}")
            root = c.segments[c.branches["main"].first]
            whole = Segment(root.id, 0, "main", "mutable", 0, c.domain, 0)
            v = c.bind(name, pk, whole, ddl, defaults)
            c.tables[name].agree = agree
            load(c, v, whole)

        with self.log.lease(self.at):
            self.publish(change)

    def register_table(self, name: str, df: DataFrame, pk: list[str], defaults: dict[str, str] | None = None, agree: bool = False) -> None:
        """Copy df as the table's first rows, visible to every branch. pk must be unique and not null.
        agree: equal values written on both sides of a merge are no conflict."""
        self._registering(name, df, pk, True, agree, defaults, lambda c, v, s: self._append(c, df, v, s, base=True))

    def adopt(self, name: str, path: str, pk: list[str], verify: bool = True, agree: bool = False, defaults: dict[str, str] | None = None) -> None:
        """Register a folder or file of Parquet as it lies: nothing is copied, and the files must not change. verify
        looks once whether pk is unique and not null; without it that is the caller's word."""
        df = self.spark.read.parquet(path)

        def load(c: Catalog, v: Version, s: Segment) -> None:
            c.commits.append(Commit(c.next_seq, v.id, path, s.lo, s.hi, s.id, -1, True, True))
            c.next_seq += 1

        self._registering(name, df, pk, verify, agree, defaults, load)

    def _append(self, c: Catalog, rows: DataFrame, v: Version, s: Segment, deleted: bool = False, base: bool = False) -> Commit:
        """Write rows (the version's columns; only keys matter if deleted) as one commit of c."""
        seq, c.next_seq = c.next_seq, c.next_seq + 1
        path = f"{self.root}/data/{v.table}/v{v.id}/{seq:09d}-{uuid.uuid4().hex[:8]}"
        names = StructType.fromDDL(v.ddl)
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names]
        gone = F.col("_deleted") if "_deleted" in rows.columns else F.lit(deleted)
        meta = [F.lit(s.lo).alias("live_lo"), F.lit(s.hi).alias("live_hi"), F.lit(s.id).cast("long").alias("writer_segment_id"), gone.alias("deleted"), F.lit(seq).cast("long").alias("seq")]
        rows.select(*cols, *meta).write.parquet(path)
        n = self.spark.read.parquet(path).count()  # from the footers
        commit = Commit(seq, v.id, path, s.lo, s.hi, s.id, n, base)
        c.commits.append(commit)
        return commit

    # -- sessions ------------------------------------------------------------------------------------
    def checkout(self, branch: str = "main") -> BranchSession:
        self.catalog.branch(branch)
        return BranchSession(self, branch)

    def checkout_checkpoint(self, name: str) -> BranchSession:
        c = self.catalog.checkpoints[name]
        return BranchSession(self, c.branch, point=self.catalog.segments[c.segment].point)

    # -- diff ------------------------------------------------------------------------------------------
    def _rows(self, table: str, point: int, v: Version | None = None) -> DataFrame | None:
        v = v or self.catalog.bound(table, point)
        return S.visible(self.spark, self.catalog, v, point) if v else None

    def candidates(self, v: Version, writers: set[int]) -> tuple[DataFrame, bool]:
        """Keys that some of these writers wrote, and whether they are known to be few. Commits
        carry their writer, so only compacted bases are filtered row by row."""
        mine = [c for c in self.catalog.commits if c.version == v.id]
        plain = [c for c in mine if not c.base and c.writer in writers]
        bases = [c for c in mine if c.base and c.writer < 0]
        keys = S.records(self.spark, v, plain).select(*v.pk)
        if bases:
            keys = keys.union(S.records(self.spark, v, bases).where(F.col("writer_segment_id").isin(sorted(writers))).select(*v.pk))
        return keys.distinct(), not bases and sum(c.rows for c in plain) <= S.BROADCAST_ROWS

    def diff(self, left: str, right: str, table: str) -> DataFrame:
        """(table, key, change, before, after) between two branches' heads."""
        c = self.catalog
        a, b = c.head(left), c.head(right)
        va, vb = c.bound(table, a.point), c.bound(table, b.point)
        if va and vb and va.id == vb.id:  # only keys written by segments that one side alone has
            sa, sb = {s.id for s in c.ancestry(a.id)}, {s.id for s in c.ancestry(b.id)}
            keys, few = self.candidates(va, sa ^ sb)
            sides = [S.by_keys(self._rows(table, p.point, va), keys, va.pk, few) for p in (a, b)]
            return D.row_diff(*sides, va.pk, table)
        v = va or vb
        if v is None:
            raise TableNotRegisteredError(table)
        empty = self.spark.createDataFrame([], v.ddl)
        return D.row_diff(self._rows(table, a.point) if va else empty, self._rows(table, b.point) if vb else empty, v.pk, table)

    def diff_all(self, left: str, right: str) -> DataFrame:
        names = sorted({*self.catalog.visible_tables(self.catalog.head(left).point), *self.catalog.visible_tables(self.catalog.head(right).point)})
        out = None
        for t in names:
            d = self.diff(left, right, t)
            out = d if out is None else out.unionByName(d)
        return out

    # -- merge -----------------------------------------------------------------------------------------
    def three_way(self, source: str, target: str, table: str) -> tuple[Version, DataFrame]:
        c = self.catalog
        s, t = c.head(source), c.head(target)
        point, left, right = c.merge_base(s.id, t.id)
        v, vs = c.bound(table, t.point), c.bound(table, s.point)
        if v is None or vs is None or v.id != vs.id:
            raise BranchError(f"{table}: the branches' schemas differ")
        keys, few = self.candidates(v, left | right)
        pick = lambda p: S.by_keys(self._rows(table, p, v), keys, v.pk, few)
        return v, D.three_way(pick(point), pick(s.point), pick(t.point), v.pk, c.tables[table].agree)

    def merge_preview(self, source: str, target: str, tables: list[str] | None = None) -> MergePreview:
        """What a merge would change, and its conflicts; both branches' states are remembered to detect staleness."""
        c = self.catalog
        names = tables or sorted({*c.visible_tables(c.head(source).point)} & {*c.visible_tables(c.head(target).point)})
        return MergePreview(source, target, (c.state(source), c.state(target)), {t: self.three_way(source, target, t) for t in names})

    def merge(self, source: str, target: str, policy: str = "abort_on_conflict", tables: list[str] | None = None, choices: DataFrame | None = None,
              selection: DataFrame | None = None, resolver: Callable | None = None, validators: list[Callable] = (), preview: MergePreview | None = None) -> dict:
        """Apply the source's changes to the target.

        choices: (conflict_id, choice) with source or target, needed by manual_review.
        selection: (change_id) allow-list. resolver: preview -> choices, for custom.
        validators: called with the preview; an exception aborts. A write to either branch between
        the preview and the publication makes a given preview stale; without one, the merge starts again.
        """
        for attempt in range(RETRIES):
            self.refresh()
            change, applied = self.prepared_merge(source, target, policy, tables, choices, selection, resolver, validators, preview)
            try:
                with self.log.lease(self.at):
                    self.publish(change)
                return applied
            except StalePreviewError:
                if preview is not None or choices is not None or selection is not None:
                    raise
                self._lost(attempt)
        raise CommitConflict(f"{source} or {target} moved, again and again")

    def prepared_merge(self, source: str, target: str, policy: str = "abort_on_conflict", tables: list[str] | None = None, choices: DataFrame | None = None,
                       selection: DataFrame | None = None, resolver: Callable | None = None, validators: list[Callable] = (), preview: MergePreview | None = None) -> tuple[Callable[[Catalog], None], dict]:
        """A checked merge as a change of a catalog, and what it will have applied by then (rows of each
        table). The change raises StalePreviewError where a branch has moved since the preview."""
        if policy not in POLICIES:
            raise ValueError(f"unknown policy: {policy}")
        preview = preview or self.merge_preview(source, target, tables)
        preview.expect(self.catalog)
        for check in validators:
            check(preview)
        if policy == "custom":
            if resolver is None:
                raise ValueError("custom needs a resolver")
            choices = resolver(preview)
        conflicts = preview.conflicts()
        if policy in ("abort_on_conflict", "snapshot_isolation") and conflicts.limit(1).count():
            raise MergeConflictError(f"merging {source} into {target} conflicts")
        if policy in ("manual_review", "custom"):
            if choices is None and conflicts.limit(1).count():
                raise MergeConflictError("conflicts need choices")
            if choices is not None:
                if choices.join(conflicts, "conflict_id", "left_anti").limit(1).count():
                    raise StalePreviewError("a choice names no conflict of this merge")
                if conflicts.join(choices, "conflict_id", "left_anti").limit(1).count():
                    raise MergeConflictError("a conflict has no choice")
        applied: dict[str, int] = {}

        def change(c: Catalog) -> None:
            preview.expect(c)
            merge, _ = c.merge_segments(target)
            for table, (v, rows) in preview.tables.items():
                keyed = preview.identified(table, v, rows)
                if policy in ("source_wins", "weak_snapshot_isolation"):
                    take = keyed
                elif policy in ("manual_review", "custom") and choices is not None:
                    mine = choices.where(F.col("choice").isin("source", "theirs")).select("conflict_id")
                    take = keyed.where("outcome = 'clean'").unionByName(keyed.where("outcome = 'conflict'").join(mine, "conflict_id", "left_semi").select(*keyed.columns))
                else:
                    take = keyed.where("outcome = 'clean'")
                if selection is not None:
                    take = take.join(selection, "change_id", "left_semi")
                take = take.where(~D.same(F.col("s"), F.col("t")))  # nothing to apply
                names = S.names_of(v)
                value = [F.when(F.col("s").isNull(), F.col(f"t.{n}")).otherwise(F.col(f"s.{n}")).alias(n) for n in names]
                out = take.select(*value, F.col("s").isNull().alias("_deleted"))
                applied[table] = self._append(c, out, v, merge).rows

        return change, applied

    # -- upkeep ------------------------------------------------------------------------------------------
    def dead_segments(self) -> set[int]:
        return set(self.catalog.segments) - self.catalog.reachable()

    def compact(self, table: str) -> None:
        """One spliced base for each version of the table, without rows of unreachable writers."""
        dead = self.dead_segments()

        def change(c: Catalog):
            for v in [v for v in c.versions.values() if v.table == table]:
                mine = [x for x in c.commits if x.version == v.id]
                if not mine:
                    continue
                path = f"{self.root}/data/{table}/v{v.id}/base-{uuid.uuid4().hex[:8]}"
                S.spliced(self.spark, v, mine, dead).write.parquet(path)
                n = self.spark.read.schema(f"{v.ddl}, {S.META}").parquet(path).count()
                c.commits = [x for x in c.commits if x.version != v.id] + [Commit(c.next_seq, v.id, path, 0, c.domain, -1, n, True)]
                c.next_seq += 1

        with self.log.lease(self.at):
            self.publish(change)

    def vacuum(self) -> int:
        """Delete data folders that neither the newest catalog nor a leased version names and that were there
        before any lease began; returns how many. Writers hold a lease until they have published, readers
        while they are pinned(), so neither loses files to a vacuum in another process."""
        jvm, fs = self.spark._jvm, self.log.fs
        with self.log.lease(self.at):
            held = self.log.leases(LEASE_SECONDS)  # our own among them, so later writers are spared too
            self.refresh()
            catalogs = [self.catalog, *(Catalog.from_json(d) for d in (self.log.read(v) for v in {v for _, v in held} - {self.at}) if d)]
            known = {c.path.rsplit("/", 1)[-1] for x in catalogs for c in x.commits}
            begin, gone = min(t for t, _ in held), 0
            for v in self.catalog.versions.values():
                folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{v.table}/v{v.id}")
                for s in fs.listStatus(folder) if fs.exists(folder) else []:
                    inside = [x.getModificationTime() for x in fs.listStatus(s.getPath())]
                    if s.getPath().getName() not in known and max(inside, default=s.getModificationTime()) < begin:
                        fs.delete(s.getPath(), True)
                        gone += 1
        return gone


@dataclass
class MergePreview:
    source: str
    target: str
    states: tuple[tuple, tuple]
    tables: dict[str, tuple[Version, DataFrame]]

    def expect(self, c: Catalog) -> None:
        if self.states != (c.state(self.source), c.state(self.target)):
            raise StalePreviewError("a branch has moved since the preview")

    def identified(self, table: str, v: Version, rows: DataFrame) -> DataFrame:
        names = S.names_of(v)
        key = F.to_json(F.struct(*v.pk))
        before, after, base = D.payload(names, "t"), D.payload(names, "s"), D.payload(names, "b")
        out = rows.withColumn("key", key).withColumn("before", before).withColumn("after", after).withColumn("base", base)
        out = out.withColumn("change", D.change_kind("before", "after"))
        return out.withColumn("change_id", D.change_id(F.lit(table), F.col("key"), F.col("before"), F.col("after"))).withColumn(
            "conflict_id", D.conflict_id(F.lit(table), F.col("key"), F.col("base"), F.col("after"), F.col("before"))
        )

    def _all(self, outcome: str, names: list[str]) -> DataFrame:
        out = None
        for table, (v, rows) in self.tables.items():
            one = self.identified(table, v, rows).where(F.col("outcome") == outcome).select(F.lit(table).alias("table"), *names)
            out = one if out is None else out.unionByName(one)
        return out

    def changes(self) -> DataFrame:
        return self._all("clean", ["key", "change", "before", "after", "change_id"])

    def conflicts(self) -> DataFrame:
        return self._all("conflict", ["key", "change", "base", "before", "after", "conflict_id", "change_id"])

    def token(self) -> str:
        """A digest of all changes and conflicts: equal previews have equal tokens."""
        ids = self._all("clean", ["change_id"]).unionByName(self._all("conflict", ["change_id"]))
        # a sum of hashes needs no global order and combines before the shuffle
        row = ids.agg(F.count("*").alias("n"), F.sum(F.xxhash64("table", "change_id").cast("decimal(38,0)")).alias("h")).first()
        return f"{row.n}-{row.h or 0}"


@dataclass
class BranchSession:
    """Reads and writes of one branch, or reads of one checkpoint."""

    store: BranchStore
    branch: str
    point: int | None = None
    spark: SparkSession = field(init=False)

    def __post_init__(self):
        self.spark = self.store.spark.newSession()
        self._pending: list[Commit] | None = None
        self._draft: Catalog | None = None
        self._fixed: Catalog | None = None

    @property
    def catalog(self) -> Catalog:
        return self._draft or self.store.catalog

    def _point(self) -> int:
        return self.catalog.head(self.branch).point if self.point is None else self.point

    def _version(self, table: str) -> Version:
        v = self.catalog.bound(table, self._point())
        if v is None:
            raise TableNotRegisteredError(table)
        return v

    # -- reads ----------------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return S.visible(self.spark, self.catalog, self._version(name), self._point())

    def get(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of some keys."""
        return self.table(name).join(keys, self._version(name).pk, "left_semi")

    def query(self, sql: str, args: dict | list | tuple | None = None) -> DataFrame:
        """Spark SQL in which each visible table's name means its rows at this branch. Parameters
        are named (:name, from a dict) or numbered ($1, from a list)."""
        if isinstance(args, (list, tuple)):
            sql, args = sqlfront.numbered(sql, args)
        for name in self.catalog.tables:
            if self.catalog.bound(name, self._point()):
                self.table(name).createOrReplaceTempView(name)
            else:
                self.spark.catalog.dropTempView(name)
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def query_many(self, statements: list[str], args: dict | None = None) -> DataFrame:
        """(query, row): the rows of several queries from one plan, as JSON, by the query's place in the list."""
        out = None
        for i, sql in enumerate(statements):
            df = self.query(sql, args)
            one = df.select(F.lit(i).alias("query"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "query int, row string") if out is None else out

    def explain(self, sql: str, args: dict | None = None) -> str:
        return self.query(sql, args)._jdf.queryExecution().toString()

    # -- writes ---------------------------------------------------------------------------------------
    @contextmanager
    def transaction(self):
        """Writes inside are published together at the end, or not at all. Nested transactions
        join the outer one. If others published meanwhile but left this branch alone, the writes go on top
        of theirs; otherwise CommitConflict is raised and nothing is kept."""
        if self._draft is not None:
            yield self
            return
        store = self.store
        store.refresh()
        base, at = store.catalog, store.at
        with store.log.lease(at):
            self._draft = draft = base.copy()
            try:
                yield self
                if draft != base:
                    self._publish(draft, base, at)
            except BaseException:
                store.discard(draft, base)
                raise
            finally:
                self._draft = None

    @contextmanager
    def pinned(self):
        """Reads of the newest version whose files no vacuum() of any process deletes meanwhile; what this or
        another session publishes inside is not seen through the session that is yielded."""
        store = self.store
        while True:
            store.refresh()
            with store.log.lease(store.at):
                if store.log.latest(store.at) != store.at:  # a vacuum may have passed in between
                    continue
                fixed = BranchSession(store, self.branch, self.point)
                fixed._draft = fixed._fixed = store.catalog
                yield fixed
                return

    def _publish(self, draft: Catalog, base: Catalog, at: int) -> None:
        store = self.store
        known = {c.seq for c in base.commits}
        mine = [c for c in draft.commits if c.seq not in known]
        streams = {k: n for k, n in draft.streams.items() if base.streams.get(k) != n}
        for attempt in range(RETRIES):
            try:
                store.log.publish(at + 1, draft.to_json())
                store.catalog, store.at = draft, at + 1
                return
            except CommitConflict:
                store._lost(attempt)
            store.refresh()
            at, newer = store.at, store.catalog
            only_rows = (draft.next_version, draft.next_segment) == (base.next_version, base.next_segment) and draft.next_seq == base.next_seq + len(mine)
            if not only_rows or self.branch not in newer.branches or newer.state(self.branch) != base.state(self.branch):
                raise CommitConflict(f"{self.branch} was written by others")
            draft = newer.copy()  # numbers of commits need only differ where both are visible
            draft.commits += mine
            draft.streams |= streams
            draft.next_seq = max([draft.next_seq, *(c.seq + 1 for c in mine)])

    def retried(self, work: Callable[[], int]) -> int:
        """Do work in a transaction, again where others wrote to the branch first; inside an outer
        transaction, once."""
        if self.point is not None:
            raise ReadOnlyError("a checkpoint can't be written")
        if self._draft is not None and self._draft is self._fixed:
            raise ReadOnlyError("a pinned session only reads")
        if self._draft is not None:
            return work()
        for attempt in range(RETRIES):
            try:
                with self.transaction():
                    return work()
            except CommitConflict:
                BranchStore._lost(attempt)
        raise CommitConflict(f"{self.branch} was written by others, again and again")

    def _write(self, table: str, rows: Callable[[Version], DataFrame], deleted: bool = False) -> int:
        """Append rows as one commit; no key may come twice among them."""

        def work() -> int:
            v = self._version(table)
            return self.store._append(self._draft, rows(v), v, self._draft.head(self.branch), deleted).rows

        return self.retried(work)

    def _frame(self, v: Version, rows, order: str | None = None) -> DataFrame:
        """Rows (a DataFrame, or a list of dicts) with defaults filled and the last of each key."""
        schema = StructType.fromDDL(v.ddl)
        if not isinstance(rows, DataFrame):
            given = {k for r in rows for k in r}
            kinds = StructType([f for f in schema if f.name in given])
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in kinds) + (i,) for i, r in enumerate(rows)], kinds.add("_ord", "long"))
            order = "_ord"
        for name, default in v.defaults.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.expr(default))
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], *([order] if order and order not in schema.fieldNames() else []))
        if order:
            rest = [n for n in schema.fieldNames() if n not in v.pk]
            last = rows.groupBy(*v.pk).agg(F.max_by(F.struct(*rest), order).alias("_v"))
            rows = last.select(*[n if n in v.pk else F.col(f"_v.{n}").alias(n) for n in schema.fieldNames()])
        return rows if order else rows.dropDuplicates(v.pk)

    def upsert(self, table: str, rows, order: str | None = None) -> int:
        """Write rows over what is there; of equal keys the last counts (by `order` in a DataFrame)."""
        return self._write(table, lambda v: self._frame(v, rows, order))

    def insert(self, table: str, rows, ignore: bool = False) -> int:
        """Add rows; a key that exists, or comes twice, is an error or (ignore) is left out."""
        def build(v: Version):
            df = self._frame(v, rows, None) if ignore else self._plain(v, rows)
            there = self.table(table).select(*v.pk)
            if ignore:
                return df.join(there, v.pk, "left_anti").select(*df.columns)
            if df.groupBy(*v.pk).count().where("count > 1").limit(1).count() or df.join(there, v.pk, "left_semi").limit(1).count():
                raise DuplicateKeyError(f"{table}: a key exists")
            return df

        return self._write(table, build)

    def _plain(self, v: Version, rows) -> DataFrame:
        """Rows with defaults filled, repeated keys and all."""
        schema = StructType.fromDDL(v.ddl)
        if isinstance(rows, DataFrame):
            given = {n: F.col(n) for n in rows.columns} | {n: F.expr(d) for n, d in v.defaults.items() if n not in rows.columns}
            return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        given = {k for r in rows for k in r}
        return df.withColumns({n: F.expr(d).cast(schema[n].dataType) for n, d in v.defaults.items() if n not in given}) if v.defaults else df

    def delete_keys(self, table: str, keys) -> int:
        """Write a tombstone for each key, whether or not it is visible."""
        def build(v: Version):
            kinds = StructType([f for f in StructType.fromDDL(v.ddl) if f.name in v.pk])
            df = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([tuple(k[f.name] for f in kinds) for k in keys], kinds)
            return df.select(*v.pk).distinct()

        return self._write(table, build, deleted=True)

    def update(self, table: str, sets: dict[str, str], where: str | None = None, args: dict | None = None) -> int:
        """Set columns to SQL expressions where a SQL condition (subqueries included) is true."""
        def build(v: Version):
            if set(sets) & set(v.pk):
                raise sqlfront.UnsupportedSQLError("a primary key can't be updated")
            schema = StructType.fromDDL(v.ddl)
            cols = ", ".join(f"CAST({sets[f.name]} AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in sets else f"`{f.name}`" for f in schema)
            return self.query(f"SELECT {cols} FROM {table}" + (f" WHERE {where}" if where else ""), args)

        return self._write(table, build)

    def delete(self, table: str, where: str | None = None, args: dict | None = None) -> int:
        def build(v: Version):
            return self.query(f"SELECT {', '.join(f'`{k}`' for k in v.pk)} FROM {table}" + (f" WHERE {where}" if where else ""), args)

        return self._write(table, build, deleted=True)

    def execute(self, sql: str, args: dict | None = None) -> int:
        """One DML or DDL statement; returns the number of rows written."""
        s = sqlfront.parse(sql)
        x = s.extra
        if s.kind == "insert":
            v = self._version(s.table)
            names = s.columns or S.names_of(v)
            body = f"SELECT * FROM VALUES {s.values} AS t({', '.join(names)})"
            return self.insert(s.table, self.spark.sql(body, args=args) if args else self.spark.sql(body), s.ignore)
        if s.kind == "update":
            return self.update(s.table, s.sets, s.where, args)
        if s.kind == "delete":
            return self.delete(s.table, s.where, args)
        if s.kind == "create":
            return self.create_table(s.table, x["ddl"], x["pk"], x["defaults"])
        if s.kind == "drop":
            return self.drop_table(s.table)
        if s.kind == "add":
            return self.add_column(s.table, x["name"], x["type"], x["default"])
        if s.kind == "drop_column":
            return self.drop_column(s.table, x["name"])
        if s.kind == "alter_type":
            return self.alter_type(s.table, x["name"], x["type"], x["using"])
        if s.kind == "index":
            return self.create_index(s.table, x["name"], s.columns)
        raise sqlfront.UnsupportedSQLError("use query() to read")

    # -- branch-local DDL --------------------------------------------------------------------------------
    def create_table(self, table: str, ddl: str, pk: list[str], defaults: dict | None = None) -> int:
        if not pk:
            raise sqlfront.UnsupportedSQLError(f"{table} needs a primary key")

        def work() -> int:
            if self._draft.bound(table, self._point()):
                raise BranchError(f"table exists: {table}")
            self._draft.bind(table, pk, self._draft.head(self.branch), ddl, defaults)
            return 0

        return self.retried(work)

    def drop_table(self, table: str) -> int:
        def work() -> int:
            self._draft.bind(table, self._version(table).pk, self._draft.head(self.branch), None)
            return 0

        return self.retried(work)

    def _reshape(self, table: str, build: Callable[[DataFrame], DataFrame], defaults: dict[str, str] | None = None) -> int:
        """Bind a new version over this branch's segment and copy the visible rows into it,
        stamped with the current segment."""

        def work() -> int:
            v = self._version(table)
            rows = build(self.table(table))
            head = self._draft.head(self.branch)
            keep = {k: d for k, d in (v.defaults | (defaults or {})).items() if k in rows.columns}
            new = self._draft.bind(table, v.pk, head, rows.schema.toDDL().replace(" NOT NULL", ""), keep)
            return self.store._append(self._draft, rows, new, head).rows

        return self.retried(work)

    def _reshape_metadata(self, table: str, build: Callable[[Version], tuple[list[StructField], dict[str, str]]], defaults: dict[str, str]) -> int:
        """Bind a new version over this branch's segment that shares the files of what is visible here; build gives
        its columns, and literals for those that the files don't hold. No job runs and no row is written. Returns
        the number of records shared, as far as commits know it."""

        def work() -> int:
            draft, v, head = self._draft, self._version(table), self._draft.head(self.branch)
            here = [c for c in draft.commits if c.version == v.id and c.lo <= head.point < c.hi]
            fields, fill = build(v)
            names = {f.name for f in fields}
            keep = {k: d for k, d in (v.defaults | defaults).items() if k in names}
            new = draft.bind(table, v.pk, head, StructType(fields).toDDL().replace(" NOT NULL", ""), keep)
            for c in here:
                known = {n: x for n, x in (c.fill | fill).items() if n in names}
                draft.commits.append(replace(c, version=new.id, lo=max(c.lo, head.lo), hi=min(c.hi, head.hi), fill=known, shared=True))
            return sum(max(c.rows, 0) for c in here)

        return self.retried(work)

    def _literal(self, default: str | None, kind: str) -> str | None:
        """SQL of the one value that a default has for all rows, or None where rows or sessions may differ."""
        if default is None:
            return f"CAST(NULL AS {kind})"
        try:
            made = self.spark.range(1).select(F.expr(default).cast(kind).alias("v"))
        except AnalysisException:  # it names other columns
            return None
        plan = made._jdf.queryExecution().optimizedPlan()
        value = plan.expressions().head().children().head() if plan.expressions().nonEmpty() else None
        if value is None or not value.getClass().getName().endswith(".Literal") or made.schema["v"].dataType.typeName() not in PLAIN:
            return None
        return f"CAST({value.sql()} AS {kind})"

    def add_column(self, table: str, name: str, kind: str, default: str | None = None) -> int:
        """Metadata alone, unless the default differs by row (rand(), another column) or has a type whose literals
        depend on the session; then the visible rows are copied."""

        def absent(columns: list[str]) -> None:
            if name in columns:
                raise BranchError(f"column exists: {name}")

        def build(v: Version) -> tuple[list[StructField], dict[str, str]]:
            absent(S.names_of(v))
            return [*StructType.fromDDL(v.ddl), *StructType.fromDDL(f"`{name}` {kind}")], {name: value}

        def copied(df: DataFrame) -> DataFrame:
            absent(df.columns)
            return df.withColumn(name, F.expr(default).cast(kind))

        absent(S.names_of(self._version(table)))
        value = self._literal(default, kind)
        defaults = {name: default} if default else {}
        return self._reshape(table, copied, defaults) if value is None else self._reshape_metadata(table, build, defaults)

    def drop_column(self, table: str, name: str) -> int:
        """Metadata alone: files keep the column, no later scan reads it."""

        def build(v: Version) -> tuple[list[StructField], dict[str, str]]:
            fields = list(StructType.fromDDL(v.ddl))
            if name in v.pk or name not in S.names_of(v):
                raise BranchError(f"can't drop {name}")
            return [f for f in fields if f.name != name], {}

        return self._reshape_metadata(table, build, {})

    def alter_type(self, table: str, name: str, kind: str, using: str | None = None) -> int:
        return self._reshape(table, lambda df: df.withColumn(name, (F.expr(using) if using else F.col(name)).cast(kind)))

    def create_index(self, table: str, name: str, cols: list[str]) -> int:
        """Recorded only: files have no B-trees; sort or cluster the table by these columns instead."""
        v = self._version(table)
        if not set(cols) <= set(S.names_of(v)):
            raise BranchError("an index takes plain columns")
        self.store.publish(lambda c: c.tables[table].indexes.__setitem__(name, cols))
        return 0

    def list_indexes(self, table: str) -> DataFrame:
        self._version(table)
        rows = [(n, cols) for n, cols in sorted(self.catalog.tables[table].indexes.items())]
        return self.spark.createDataFrame(rows, "name string, columns array<string>")
