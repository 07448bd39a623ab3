"""Merging several tables at once: identified changes, preview tokens, selections and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators.store import RETRIES, BranchError, BranchStore, MergePreview, StalePreviewError
from ramus.sources.storage import CommitConflict, SharedVersions


class IncompleteBundleError(BranchError):
    """A selection takes some changes of a bundle and leaves others."""


def preview(store: BranchStore, source: str, target: str, tables: list[str] | None = None) -> tuple[MergePreview, str]:
    """All changes of all tables, and the token that names exactly them."""
    p = store.merge_preview(source, target, tables)
    return p, p.token()


def check_bundles(changes: DataFrame, bundles: DataFrame, selection: DataFrame) -> None:
    """bundles: (bundle, change_id). A selected bundle must be selected whole."""
    flags = bundles.join(changes.select("change_id"), "change_id", "left_semi").join(selection.select("change_id", F.lit(1).alias("_s")), "change_id", "left")
    if flags.groupBy("bundle").agg(F.count("*").alias("n"), F.count("_s").alias("k")).where("k > 0 and k < n").limit(1).count():
        raise IncompleteBundleError("a bundle must be taken whole")


def merge_atomic(store: BranchStore, source: str, target: str, token: str, selection: DataFrame | None = None, bundles: DataFrame | None = None, tables: list[str] | None = None, policy: str = "abort_on_conflict") -> dict:
    """Merge what a preview's token named, in one published version. The preview is made again
    first and refused if its token differs."""
    store.refresh()
    p = store.merge_preview(source, target, tables)
    if p.token() != token:
        raise StalePreviewError("the changes are no longer those of the preview")
    if selection is not None:
        known = p.changes().select("change_id").union(p.conflicts().select("change_id"))
        if selection.join(known, "change_id", "left_anti").limit(1).count():
            raise StalePreviewError("a selected change is not in the preview")
        if bundles is not None:
            check_bundles(p.changes(), bundles, selection)
    return store.merge(source, target, policy, tables, selection=selection, preview=p)


def dependency_groups(documents: DataFrame, chunks: DataFrame, points: DataFrame, changes: DataFrame) -> DataFrame:
    """(bundle, change_id): changes of a document, its chunks and their points belong together.
    changes: (table, id, change_id); chunks: (chunk_id, document_id); points: (point_id, chunk_id)."""
    own = documents.select(F.col("document_id").alias("bundle"), F.lit("documents").alias("table"), F.col("document_id").alias("id"))
    of_chunk = chunks.select(F.col("document_id").alias("bundle"), F.lit("chunks").alias("table"), F.col("chunk_id").alias("id"))
    of_point = points.join(chunks, "chunk_id").select(F.col("document_id").alias("bundle"), F.lit("points").alias("table"), F.col("point_id").alias("id"))
    return own.unionByName(of_chunk).unionByName(of_point).join(changes, ["table", "id"]).select("bundle", "change_id")


class Workspace:
    """Several stores that are forked, checked out and merged under the same branch names."""

    def __init__(self, stores: dict[str, BranchStore]):
        self.stores = stores

    def create_branch(self, name: str, source: str = "main", **how) -> None:
        for s in self.stores.values():
            s.create_branch(name, source, **how)

    def delete_branch(self, name: str) -> None:
        for s in self.stores.values():
            s.delete_branch(name)

    def create_checkpoint(self, name: str, branch: str = "main") -> None:
        for s in self.stores.values():
            s.create_checkpoint(name, branch)

    def checkout(self, branch: str = "main") -> dict:
        return {k: s.checkout(branch) for k, s in self.stores.items()}

    def diff(self, left: str, right: str) -> DataFrame:
        out = None
        for k, s in self.stores.items():
            d = s.diff_all(left, right).withColumn("store", F.lit(k))
            out = d if out is None else out.unionByName(d)
        return out

    def merge(self, source: str, target: str, policy: str = "abort_on_conflict") -> dict:
        """Each store by itself: a conflict in one doesn't undo another."""
        return {k: s.merge(source, target, policy) for k, s in self.stores.items()}

    def preview(self, source: str, target: str) -> tuple[dict[str, MergePreview], str]:
        """Each store's preview, and one token for all of them."""
        found = {k: preview(s, source, target) for k, s in sorted(self.stores.items())}
        return {k: p for k, (p, _) in found.items()}, "/".join(f"{k}:{t}" for k, (_, t) in found.items())

    def merge_atomic(self, source: str, target: str, policy: str = "abort_on_conflict", token: str | None = None) -> dict:
        """Merge all stores in one publication of their shared log, or none: whatever fails, before or
        while another writer publishes, leaves every store as it was."""
        shared = self._shared()
        for attempt in range(RETRIES):
            drafts, applied = {}, {}
            for s in self.stores.values():
                s.refresh()
            if token is not None and self.preview(source, target)[1] != token:
                raise StalePreviewError("the changes are no longer those of the preview")
            at = shared.log.latest()
            try:
                with shared.log.lease(at):
                    for k, s in self.stores.items():
                        change, applied[k] = s.prepared_merge(source, target, policy)
                        drafts[k] = s.catalog.copy()
                        change(drafts[k])
                    if any(s.at != at for s in self.stores.values()):
                        raise CommitConflict("a store was written meanwhile")
                    shared.log.publish(at + 1, shared.documents(at) | {s.log.name: drafts[k].to_json() for k, s in self.stores.items()})
            except BaseException as e:
                for k, draft in drafts.items():
                    self.stores[k].discard(draft, self.stores[k].catalog)
                if not isinstance(e, CommitConflict):
                    raise
                BranchStore._lost(attempt)
                continue
            for k, s in self.stores.items():
                s.catalog, s.at = drafts[k], at + 1
            return applied
        raise CommitConflict("other writers were first, again and again")

    def _shared(self) -> SharedVersions:
        logs = {id(getattr(s.log, "shared", None)): getattr(s.log, "shared", None) for s in self.stores.values()}
        if len(logs) != 1 or None in logs.values():
            raise BranchError("stores that merge together share a log; see Workspace.together()")
        return next(iter(logs.values()))

    @classmethod
    def together(cls, spark: SparkSession, root: str, names: list[str]) -> Workspace:
        """Stores below one folder that share a log, so that they can merge atomically."""
        shared = SharedVersions(spark, root)
        return cls({n: BranchStore(spark, f"{root}/{n}", log=shared.of(n)) for n in names})
