"""The state of runs as one JSON file on any file system that Spark reaches."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import SparkSession


class StateFile:
    """Read once, written whole. Each write has a file of its own, which then takes the old one's name in one step; a lock keeps writers of one driver apart."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.path)
        self.lock = threading.RLock()

    def load(self, default: dict) -> dict:
        if not self.fs.exists(self.path):
            return default
        with self.lock:
            stream = self.fs.open(self.path)
            try:
                text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        return default | json.loads(text)

    def save(self, state: dict) -> None:
        self.write(self.path, json.dumps(state, indent=1))

    def write(self, to, text: str) -> None:
        """Replace a file, on whatever file system its path names, by one with this text."""
        path = self.jvm.org.apache.hadoop.fs.Path(to) if isinstance(to, str) else to
        with self.lock:
            fs = path.getFileSystem(self.conf)
            path = fs.makeQualified(path)
            part = self.jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
            stream = fs.create(part, True)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            over = self.gateway.new_array(rename, 1)
            over[0] = rename.OVERWRITE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf).rename(part, path, over)

    def delete(self, folder: str) -> None:
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.conf).delete(path, True)
