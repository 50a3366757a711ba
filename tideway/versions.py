"""The versions of a table in a folder: numbered files, each made once.

A version is a JSON file `_versions/<number>.json` below the table's folder. It is written under another name and takes
its own in one step that fails if another writer was there first, so of two writers who begin with the same version one
gets Conflict and has changed nothing. The step is atomic where renames without overwriting are (HDFS and the like) and,
by a hard link, on local file systems; an object store needs conditional writes below its Hadoop file system.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the version first."""


class VersionLog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.base = folder.rstrip("/")
        self.folder = self._path(f"{self.base}/_versions")
        self.fs = self.folder.getFileSystem(self.conf)
        self.folder = self.fs.makeQualified(self.folder)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _file(self, number: int):
        return self._path(f"{self.folder}/{number:012}.json")

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._file(number))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The newest version, its number under `number`."""
        found = self.numbers()
        return self.read(found[-1]) if found else None

    def commit(self, version: dict, after: int) -> dict:
        """Make version number after + 1, or raise Conflict if it is there."""
        version = version | {"number": after + 1}
        self.fs.mkdirs(self.folder)
        part = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        try:
            self._rename(part, self._file(after + 1))
        except Exception as e:
            if not self.fs.exists(self._file(after + 1)):
                raise
            raise Conflict(f"version {after + 1} of {self.base} was made by another writer") from e
        finally:
            self.fs.delete(part, False)
        return version

    def _rename(self, part, to) -> None:
        if to.toUri().getScheme() == "file":
            os.link(part.toUri().getPath(), to.toUri().getPath())
            return
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(part, to, none)

    def delete(self, number: int) -> None:
        self.fs.delete(self._file(number), False)
