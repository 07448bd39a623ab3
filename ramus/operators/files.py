"""File trees as three keyed tables: inodes, directory entries and byte-range blocks.

All three can be registered in a store, so files branch, diff and merge like any table.
"""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators import diff as D
from ramus.operators.store import BranchSession, BranchStore

BLOCK, ROOT = 4096, 1
INODES = "inode_id long, kind string, size long, mode int, symlink_target string"
DIRENTS = "parent_inode_id long, name string, inode_id long"
BLOCKS = "inode_id long, byte_start long, byte_end long, data binary"


def import_tree(spark: SparkSession, root: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inodes, dirents, blocks) of the files below a folder. Inode numbers are hashes of paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.element_at(F.split(F.col("path"), F.lit(base + "/"), 2), 2)
    return from_contents(files.select(path.alias("path"), F.col("content").alias("data")), block)


def inode_of(path: Column) -> Column:
    return F.when(path == "", F.lit(ROOT)).otherwise(F.abs(F.xxhash64(path)))


def from_contents(files: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables from (path, data)."""
    parts = F.split("path", "/")
    up = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("p"), F.length("data").cast("long").alias("size"))
    here = F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")
    above = F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/")
    nodes = up.select(here.alias("at"), above.alias("above"), F.element_at("p", F.col("k")).alias("name"), (F.col("k") == F.size("p")).alias("is_file"), "size").distinct()
    nodes = nodes.groupBy("at", "above", "name", "is_file").agg(F.max(F.when(F.col("is_file"), F.col("size")).otherwise(0)).alias("size"))
    inodes = nodes.select(inode_of(F.col("at")).alias("inode_id"), F.when(F.col("is_file"), "file").otherwise("dir").alias("kind"), "size", F.when(F.col("is_file"), 420).otherwise(493).alias("mode"), F.lit(None).cast("string").alias("symlink_target"))
    dirents = nodes.select(inode_of(F.col("above")).alias("parent_inode_id"), "name", inode_of(F.col("at")).alias("inode_id"))
    n = F.ceil(F.length("data") / block).cast("int")
    cut = files.where(F.length("data") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("s", F.col("i").cast("long") * block)
    blocks = cut.select(inode_of(F.col("path")).alias("inode_id"), F.col("s").alias("byte_start"), F.least(F.col("s") + block, F.length("data")).alias("byte_end"), F.substring(F.col("data"), (F.col("s") + 1).cast("int"), F.lit(block)).alias("data"))
    return inodes, dirents, blocks


def paths(inodes: DataFrame, dirents: DataFrame, deepest: int = 64) -> DataFrame:
    """(inode_id, path) by walking down from the root, one join for each level that exists. Raises
    ValueError where the tree has more than `deepest` levels below the first, or a cycle."""
    level = dirents.where(F.col("parent_inode_id") == ROOT).select("inode_id", F.col("name").alias("path"))
    out = level
    for depth in range(deepest + 1):
        level = dirents.join(level.select(F.col("inode_id").alias("parent_inode_id"), F.col("path").alias("above")), "parent_inode_id").select("inode_id", F.concat_ws("/", "above", "name").alias("path"))
        if not level.limit(1).count():
            break
        if depth == deepest:
            raise ValueError(f"file tree deeper than {deepest + 1} levels, or a cycle of inodes")
        out = out.unionByName(level)
    return out.join(inodes.select("inode_id"), "inode_id", "left_semi")


def manifest(inodes: DataFrame, dirents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, kind, size, hash): the hash covers block positions and contents."""
    one = blocks.select("inode_id", "byte_start", F.sha2("data", 256).alias("h"))
    hashed = one.groupBy("inode_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "h"))), lambda x: x.h), ","), 256).alias("hash"))
    return paths(inodes, dirents).join(inodes.select("inode_id", "kind", "size"), "inode_id").join(hashed, "inode_id", "left").select("path", "kind", "size", "hash")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, change) between two manifests."""
    return D.row_diff(left, right, ["path"], "files").select(F.get_json_object("key", "$.path").alias("path"), "change")


def read_range(blocks: DataFrame, inode: int, begin: int, length: int) -> DataFrame:
    """(data): bytes [begin, begin + length) of a file, as far as it has blocks; gaps between them are zeros.
    Only blocks that overlap are read."""
    hit = blocks.where((F.col("inode_id") == inode) & (F.col("byte_start") < begin + length) & (F.col("byte_end") > begin))
    at = F.greatest(F.col("byte_start") - F.lit(begin), F.lit(0)).cast("int")
    part = F.substring(F.col("data"), (F.greatest(F.lit(begin) - F.col("byte_start"), F.lit(0)) + 1).cast("int"), (F.least(F.col("byte_end"), F.lit(begin + length)) - F.greatest(F.col("byte_start"), F.lit(begin))).cast("int"))
    parts = hit.select(at.alias("at"), F.hex(part).alias("x")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    whole = F.aggregate("p", F.lit(""), lambda done, b: F.concat(done, zeros(b.at - F.length(done) / 2), b.x))
    return parts.select(F.unhex(whole).alias("data"))


def write_range(blocks: DataFrame, inode: int, begin: int, data: bytes, block: int = BLOCK) -> DataFrame:
    """The blocks of one file that a write at an offset changes, to be upserted: whole blocks,
    zero-filled past the old end."""
    spark = blocks.sparkSession
    end = begin + len(data)
    first, last = begin // block, max(begin, end - 1) // block
    want = spark.range(first, last + 1).select(F.lit(inode).cast("long").alias("inode_id"), (F.col("id") * block).alias("byte_start"))
    old = want.join(blocks.where(F.col("inode_id") == inode), ["inode_id", "byte_start"], "left")
    s = F.col("byte_start")
    was = F.coalesce(F.hex("data"), F.lit(""))
    lo, hi = F.greatest(F.lit(begin) - s, F.lit(0)).cast("int"), F.least(F.lit(end) - s, F.lit(block)).cast("int")
    new = F.substring(F.lit(data.hex()), ((s + lo - begin) * 2 + 1).cast("int"), (hi - lo) * 2)
    left = F.rpad(F.substring(was, F.lit(1), lo * 2), lo * 2, F.lit("0"))
    right = F.substring(was, hi * 2 + 1, F.lit(2 * block))
    out = F.unhex(F.concat(left, new, right))
    return old.select("inode_id", "byte_start", (s + F.length(out)).alias("byte_end"), out.alias("data"))


def overlay_merge(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Source's rows over the target's, no conflict detection."""
    return source.unionByName(target.join(source.select(*key), key, "left_anti"))


def _line_diffs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        at, out = b.schema.names.index, []
        for base, after in zip(b.column(at("base")).to_pylist(), b.column(at("after")).to_pylist()):
            known = base is not None or after is not None
            out.append("\n".join(difflib.unified_diff((base or "").splitlines(), (after or "").splitlines(), "base", "after", lineterm="", n=1)) if known else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "text_diff"])


def block_merge_preview(store: BranchStore, source: str, target: str, blocks: str = "blocks", tables: tuple[str, str] = ("inodes", "dirents")) -> DataFrame:
    """(path, inode_id, byte_start, outcome, base, before, after, text_diff) for each block that a merge changes
    or that conflicts. base, before and after hold blocks that are UTF-8 text, null ones are absent or not text; the
    difference is that of lines from base to after. A file's path is the source's."""
    rows = store.merge_preview(source, target, [blocks]).tables[blocks][1]
    text = lambda side: F.when(F.is_valid_utf8(F.col(f"{side}.data").cast("string")) & ~F.contains(F.col(f"{side}.data"), F.lit(b"\0")), F.col(f"{side}.data").cast("string"))
    seen = rows.select("inode_id", "byte_start", "outcome", text("b").alias("base"), text("t").alias("before"), text("s").alias("after"))
    out = seen.mapInArrow(_line_diffs, seen.schema.simpleString()[7:-1].replace(":", " ") + ", text_diff string")
    s = store.checkout(source)
    where = paths(*(s.table(t) for t in tables)).withColumnRenamed("inode_id", "_i")
    return out.join(where, F.col("inode_id") == F.col("_i"), "left").select("path", *out.columns)


class FileTree:
    """File operations on a branch whose store has the tables inodes, dirents and blocks. Each
    operation is a few keyed reads and one transaction; errors are Python's own (FileNotFoundError and its kin)."""

    def __init__(self, session: BranchSession, block: int = BLOCK):
        self.session, self.block = session, block

    @classmethod
    def create(cls, store: BranchStore, branch: str = "main") -> FileTree:
        """An empty tree on a store without one."""
        session = store.checkout(branch)
        with session.transaction():
            for name, ddl, pk in (("inodes", INODES, ["inode_id"]), ("dirents", DIRENTS, ["parent_inode_id", "name"]), ("blocks", BLOCKS, ["inode_id", "byte_start"])):
                session.create_table(name, ddl, pk)
        return cls(session)

    # -- lookups
    def _child(self, parent: int, name: str) -> int | None:
        row = self.session.table("dirents").where((F.col("parent_inode_id") == parent) & (F.col("name") == name)).select("inode_id").first()
        return row and row.inode_id

    def _find(self, path: str) -> int | None:
        node: int | None = ROOT
        for name in _names(path):
            node = self._child(node, name)
            if node is None:
                return None
        return node

    def _place(self, path: str) -> tuple[int, str]:
        """(inode of the directory, name) of a path that need not exist."""
        *above, name = _names(path) or [""]
        if not name:
            raise IsADirectoryError(path)
        parent = "/".join(above)
        if self.stat(parent)["kind"] != "dir":
            raise NotADirectoryError(parent)
        return self._find(parent), name

    def exists(self, path: str) -> bool:
        return self._find(path) is not None

    def stat(self, path: str) -> dict:
        node = self._find(path)
        if node == ROOT:
            return {"inode_id": ROOT, "kind": "dir", "size": 0, "mode": 0o755, "symlink_target": None}
        row = None if node is None else self.session.table("inodes").where(F.col("inode_id") == node).first()
        if row is None:
            raise FileNotFoundError(path)
        return row.asDict()

    def listdir(self, path: str = "") -> DataFrame:
        """(name, kind, size) of a directory's entries, by name."""
        here = self.stat(path)
        if here["kind"] != "dir":
            raise NotADirectoryError(path)
        mine = self.session.table("dirents").where(F.col("parent_inode_id") == here["inode_id"]).select("name", "inode_id")
        return mine.join(self.session.table("inodes").select("inode_id", "kind", "size"), "inode_id").select("name", "kind", "size").orderBy("name")

    def readlink(self, path: str) -> str:
        at = self.stat(path)
        if at["kind"] != "symlink":
            raise OSError(f"not a symlink: {path}")
        return at["symlink_target"]

    def _file(self, path: str) -> dict:
        at = self.stat(path)
        if at["kind"] != "file":
            raise IsADirectoryError(path) if at["kind"] == "dir" else OSError(f"not a file: {path}")
        return at

    def read(self, path: str, begin: int = 0, length: int | None = None) -> bytes:
        at = self._file(path)
        length = max(0, min(at["size"] - begin, at["size"] if length is None else length))
        data = read_range(self.session.table("blocks"), at["inode_id"], begin, length).first().data if length else b""
        return bytes(data or b"").ljust(length, b"\0")

    # -- changes
    def _make(self, path: str, kind: str, mode: int, target: str | None = None) -> int:
        parent, name = self._place(path)
        if self._child(parent, name) is not None:
            raise FileExistsError(path)
        node = 2 + uuid.uuid4().int % (2**62)
        with self.session.transaction():
            self.session.upsert("inodes", [{"inode_id": node, "kind": kind, "size": 0, "mode": mode, "symlink_target": target}])
            self.session.upsert("dirents", [{"parent_inode_id": parent, "name": name, "inode_id": node}])
        return node

    def mkdir(self, path: str, mode: int = 0o755) -> None:
        self._make(path, "dir", mode)

    def symlink(self, target: str, path: str) -> None:
        self._make(path, "symlink", 0o777, target)

    def chmod(self, path: str, mode: int) -> None:
        self.session.update("inodes", {"mode": str(int(mode))}, f"inode_id = {self.stat(path)['inode_id']}")

    def _resize(self, node: int, size: int) -> None:
        self.session.update("inodes", {"size": str(size)}, f"inode_id = {node}")

    def write(self, path: str, data: bytes, begin: int = 0) -> None:
        """Write at an offset, making the file if there is none; what lies beyond stays."""
        if begin < 0:
            raise ValueError("an offset can't be negative")
        with self.session.transaction():
            if not self.exists(path):
                self._make(path, "file", 0o644)
            at = self._file(path)
            if data:
                self.session.upsert("blocks", write_range(self.session.table("blocks"), at["inode_id"], begin, data, self.block))
            if begin + len(data) > at["size"]:
                self._resize(at["inode_id"], begin + len(data))

    def truncate(self, path: str, size: int) -> None:
        """Cut a file, or lengthen it by zeros, which take no blocks."""
        if size < 0:
            raise ValueError("a size can't be negative")
        at = self._file(path)
        node = at["inode_id"]
        with self.session.transaction():
            self.session.delete("blocks", f"inode_id = {node} AND byte_start >= {size}")
            edge = {"data": f"substring(data, 1, CAST({size} - byte_start AS INT))", "byte_end": str(size)}
            self.session.update("blocks", edge, f"inode_id = {node} AND byte_end > {size}")
            self._resize(node, size)

    def _remove(self, parent: int, name: str, node: int) -> None:
        with self.session.transaction():
            self.session.delete_keys("dirents", [{"parent_inode_id": parent, "name": name}])
            self.session.delete_keys("inodes", [{"inode_id": node}])
            self.session.delete("blocks", f"inode_id = {node}")

    def unlink(self, path: str) -> None:
        at = self.stat(path)
        if at["kind"] == "dir":
            raise IsADirectoryError(path)
        self._remove(*self._place(path), at["inode_id"])

    def rmdir(self, path: str) -> None:
        if self.listdir(path).limit(1).count():
            raise OSError(f"directory not empty: {path}")
        self._remove(*self._place(path), self._find(path))

    def rename(self, old: str, new: str) -> None:
        """Move a file or directory; a file or an empty directory in its place is replaced. The inode, and
        so all below a directory, stays."""
        at, (parent, name) = self.stat(old), self._place(old)
        if (_names(new) + [""])[: len(_names(old))] == _names(old) and _names(new) != _names(old):
            raise OSError(f"can't move {old} into itself")
        to, as_ = self._place(new)
        there = self._child(to, as_)
        if there == at["inode_id"]:
            return
        with self.session.transaction():
            if there is not None:
                kind = self.stat(new)["kind"]
                if (kind == "dir") != (at["kind"] == "dir"):
                    raise IsADirectoryError(new) if kind == "dir" else NotADirectoryError(new)
                self.rmdir(new) if kind == "dir" else self.unlink(new)
            self.session.delete_keys("dirents", [{"parent_inode_id": parent, "name": name}])
            self.session.upsert("dirents", [{"parent_inode_id": to, "name": as_, "inode_id": at["inode_id"]}])


def _names(path: str) -> list[str]:
    names = [x for x in path.split("/") if x not in ("", ".")]
    if ".." in names:
        raise ValueError("paths go down from the root")
    return names
