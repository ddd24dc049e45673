"""Snapshots as written tables: a run writes a new version, then one small pointer file names it."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import buckets

MISSING = None


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def has(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str, default=MISSING):
    """A small JSON file by Hadoop's file systems; ``default`` if it is missing, an error if it is broken."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return default
    stream = fs.open(p)
    try:
        data = bytes(b & 0xFF for b in spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    finally:
        stream.close()
    return json.loads(data.decode("utf-8-sig"))


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1))


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder; nothing happens if it isn't there."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target, then renames over it in one step: readers see the old file or the new one, never none."""
    p, fs = _fs(spark, path)
    new, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, p, over)


class Store:
    """Named tables of versions under a root; ``current.json`` is the commit point.

    Tables named in ``bucketed`` (with their key) hold one row a key and are dealt in buckets of it (``sources.buckets``).
    """

    def __init__(self, spark: SparkSession, root: str, bucketed: dict[str, str] | None = None):
        self.spark, self.root, self.bucketed = spark, root.rstrip("/"), bucketed or {}

    def current(self) -> str | None:
        return (read_json(self.spark, f"{self.root}/current.json", {}) or {}).get("version")

    def read(self, table: str, version: str | None = None) -> DataFrame | None:
        version = version or self.current()
        return None if version is None else buckets.read(self.spark, f"{self.root}/{version}/{table}")

    def tables(self) -> set[str]:
        """Names of the current version's tables."""
        version = self.current()
        if version is None:
            return set()
        p, fs = _fs(self.spark, f"{self.root}/{version}")
        return {x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()}

    def write(self, tables: dict[str, DataFrame]) -> str:
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            path, key = f"{self.root}/{version}/{name}", self.bucketed.get(name)
            if key in df.columns:
                buckets.write(buckets.baseline(df, key), path, key)
            else:
                df.write.parquet(path)
        return version

    def commit(self, version: str) -> None:
        write_json(self.spark, f"{self.root}/current.json", {"version": version})


class Lock:
    """One writer at a time; a lock older than ``stale`` seconds is taken over.

    A stale file is first renamed to a name of the taker's own. Of two takers one renames and the other finds it gone,
    so neither deletes the lock that the other has just made. On release only the own lock, told by its token, goes.
    """

    def __init__(self, spark: SparkSession, path: str, stale: float = 6 * 3600):
        self.spark, self.path, self.stale, self.token = spark, path, stale, uuid.uuid4().hex

    def __enter__(self):
        p, fs = _fs(self.spark, self.path)
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.stale:
            own, _ = _fs(self.spark, f"{self.path}.{self.token}.stale")
            try:
                fs.rename(p, own)
            except Exception:  # another run has taken it
                pass
            fs.delete(own, False)
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise RuntimeError(f"another run holds {self.path}") from e
        out.write(bytearray(self.token.encode()))
        out.close()
        return self

    def holder(self) -> str | None:
        """The token in the lock file."""
        p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(b & 0xFF for b in self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def __exit__(self, *_):
        if self.holder() == self.token:
            delete(self.spark, self.path)
