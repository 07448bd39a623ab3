"""Where versions live: paths through Hadoop's file systems, so local disks and object stores work alike."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Schemes of stores without an atomic rename.
OBJECT_STORES = ("s3a", "s3", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn", "obs")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, else (one local JVM) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ramus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_root(spark: SparkSession, name: str = "store") -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


class JsonVersions:
    """Numbered JSON documents under one folder. A number is created once: by a hard link on a local disk, by a
    rename that refuses an existing target where renaming is atomic (HDFS), by a conditional put on an
    object store whose client offers it. Other stores are refused, as two writers could both win there."""

    def __init__(self, spark: SparkSession, root: str):
        self.gateway, self.jvm, self.conf = spark.sparkContext._gateway, spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self._path("").getFileSystem(self.conf)
        self.scheme = self.fs.getUri().getScheme()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def latest(self, since: int = -1) -> int:
        """The newest number, looked for from `since` on. Numbers have no gaps, so one look tells whether it is still
        the newest, and doubled steps find a later one."""

        def there(n: int) -> bool:
            return self.fs.exists(self._path(f"{n:09d}.json"))

        lo, step = since, 1
        while there(lo + step):
            lo, step = lo + step, step * 2
        hi = lo + step  # lo is there (or -1), hi is not
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if there(mid) else (lo, mid)
        return lo

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{version:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> None:
        body, target = bytearray(json.dumps(content, sort_keys=True).encode()), self._path(f"{version:09d}.json")
        if self.scheme in OBJECT_STORES:
            self._put(target, body, version)
            return
        tmp = self._path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        out.write(body)
        out.close()
        try:
            if self.scheme == "file":
                local = lambda p: self.jvm.java.io.File(self.fs.makeQualified(p).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(tmp))
            else:
                none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(tmp, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {version} exists") from None
            raise
        finally:
            if self.fs.exists(tmp):
                self.fs.delete(tmp, False)

    def _put(self, target, body: bytearray, version: int) -> None:
        try:
            out = self.fs.createFile(target).overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
            out.write(body)
            out.close()
        except Py4JJavaError as e:
            if self.fs.exists(target) and "IllegalArgument" not in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {version} exists") from None
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

    @contextmanager
    def lease(self, version: int):
        """While held, nothing that this version names is cleaned up, nor what is written meanwhile."""
        path = self._path(f"leases/{version}-{uuid.uuid4().hex}")
        self.fs.create(path, False).close()
        try:
            yield
        finally:
            self.fs.delete(path, False)

    def leases(self, expire: float) -> list[tuple[int, int]]:
        """(begin in the file system's milliseconds, version) of each lease. Those that began `expire` seconds
        before the newest are of crashed holders and are deleted."""
        found = [(s.getModificationTime(), s.getPath()) for s in self.fs.listStatus(self._path("leases"))]
        newest = max(t for t, _ in found)
        for t, p in found:
            if t < newest - expire * 1000:
                self.fs.delete(p, False)
        return [(t, int(p.getName().rsplit("-", 1)[0])) for t, p in found if t >= newest - expire * 1000]


class SharedVersions:
    """One version log for several stores: each version holds all of their documents, so one publication
    can change many stores at once, or none."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.log = root, JsonVersions(spark, f"{root}/shared")

    def of(self, name: str) -> StoreLog:
        return StoreLog(self, name)

    def documents(self, version: int) -> dict[str, dict]:
        return self.log.read(version) if version >= 0 else {}


class StoreLog:
    """One store's part of a shared log; numbered as the shared log is."""

    def __init__(self, shared: SharedVersions, name: str):
        self.shared, self.name, self.fs = shared, name, shared.log.fs

    def latest(self, since: int = -1) -> int:
        return self.shared.log.latest(since)

    def read(self, version: int) -> dict | None:
        return self.shared.documents(version).get(self.name)

    def publish(self, version: int, content: dict) -> None:
        self.shared.log.publish(version, self.shared.documents(version - 1) | {self.name: content})

    def delete(self, path: str) -> None:
        self.shared.log.delete(path)

    def lease(self, version: int):
        return self.shared.log.lease(version)

    def leases(self, expire: float) -> list[tuple[int, int]]:
        return self.shared.log.leases(expire)
