"""Committed table snapshots (D1, D4, D5, D6, D8, S1): changes that readers see whole or not at all.

A table is cut into buckets by a hash of its key. A version is a *manifest*: for each bucket the
folder that holds its rows. A change reads and rewrites the buckets of the keys it
touches, into new folders, and then creates the next manifest; all other buckets keep their folders.
Nothing is ever overwritten, so a reader that holds a version goes on reading it, and a writer
that dies leaves folders that no manifest names.

The manifest ``v<n>`` is first written aside and then renamed. A rename onto an existing name
fails, so of two writers that start from the same version one commits and the other gets ``Conflict``,
and may begin again from the newer version. The manifest has one line per bucket; it's the
only thing that the driver reads or writes itself, through the file system that Spark uses.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to commit."""


class _Files:
    """The few file-system calls that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        if getattr(spark, "_jsc", None) is None:
            raise RuntimeError("committed snapshots need a session with a JVM driver, not Spark Connect")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes ``text`` aside and renames it to ``name``; False if that exists."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(self.path(name)) and self.fs.rename(self.path(aside), self.path(name)):
            return True
        self.fs.delete(self.path(aside), False)
        return False


class Snapshots:
    """The versions of one table under ``root``; ``key`` decides the bucket of a row (null keys
    have one too)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.files = _Files(spark, root)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        names = self.files.names(f"{self.root}/manifests")
        return max((int(n[1:]) for n in names if n[1:].isdigit() and n[0] == "v"), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(f"{self.root}/manifests/v{self.version() if version is None else version}"))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest by default), or of some of its buckets."""
        manifest = self.manifest(version)
        folders = [f for b, f in sorted(manifest["folders"].items(), key=lambda x: int(x[0]))
                   if buckets is None or int(b) in buckets]
        schema = manifest["schema"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def _write(self, rows: DataFrame, tag: str) -> dict[str, str]:
        """Writes rows by bucket; bucket -> folder of those that have rows. A bucket's rows are dealt over
        several tasks when they are many (AQE splits what the rebalance makes too large)."""
        folder = f"{self.root}/data/{tag}"
        rows = rows.withColumn("_bucket", self.bucket())
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        return {n.split("=")[1]: f"{tag}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}

    def _commit(self, version: int, folders: dict[str, str], schema: str) -> int:
        text = json.dumps({"schema": schema, "folders": folders}, sort_keys=True)
        if not self.files.create(f"{self.root}/manifests/v{version}", text):
            raise Conflict(f"version {version} of {self.root} is already there")
        return version

    def create(self, rows: DataFrame) -> int:
        """Commits ``rows`` as a whole new version."""
        version = self.version() + 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return self._commit(version, self._write(rows, f"v{version}-{uuid.uuid4().hex[:8]}"), schema)

    def change(self, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> int:
        """Commits the next version: ``rewrite`` gets the rows of all buckets that ``keys`` (a column named as
        the key) fall into and returns the rows to stand in their place. Buckets of no key are not
        read. Without keys, nothing is committed. Returns the newest version."""
        version = self.version()
        manifest = self.manifest(version)
        touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]    # at most ``buckets`` numbers
        if not touched:
            return version
        new = rewrite(self.read(version, touched)).select(*self.read(version, []).columns)
        written = self._write(new, f"v{version + 1}-{uuid.uuid4().hex[:8]}")
        strayed = sorted(set(written) - {str(b) for b in touched})
        if strayed:
            raise ValueError(f"rewrite returned rows of buckets {strayed}, which no given key falls into")
        kept = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
        return self._commit(version + 1, kept | written, manifest["schema"])
