"""Versioned commits in a shared folder: one new file makes a run visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another run committed this version first."""


class CommitLog:
    """``root/_commits/000000000007.json`` says what version 7 consists of.

    A manifest is written under a scratch name and then renamed to its version
    without overwriting, which file systems of clusters do in one step. Data
    written by a run that dies before is named in no manifest and so never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        qualified = self._fs.makeQualified(self._path(self.root))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))

    def fresh(self, kind: str) -> str:
        """A path that no other run uses."""
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def names(self, path: str) -> list[str]:
        """What lies directly in a folder."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_commits")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest version and its manifest; (0, {}) before the first commit."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (0, {})

    def commit(self, after: int, manifest: dict) -> int:
        """Make version after + 1; CommitConflict if it exists already."""
        scratch = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(scratch, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target = self._path(f"{self.root}/_commits/{after + 1:012d}.json")
        try:
            self._context.rename(scratch, target, self._rename)
        except Exception as error:
            self._fs.delete(scratch, False)
            if self._fs.exists(target):
                raise CommitConflict(f"version {after + 1} exists") from error
            raise
        return after + 1
