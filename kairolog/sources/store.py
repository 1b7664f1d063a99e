"""Small files of metadata on any file system that Spark can reach."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this transaction."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> dict:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> None:
        """Fails if the file is there: of two writers one succeeds."""
        path = self._path(name)
        try:
            stream = self._fs(path).create(path, False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise Conflict(name) from None
            raise
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def copy(self, other: Store, name: str) -> None:
        """The file or folder of this name in another store, as it is."""
        there, here = other._path(name), self._path(name)
        self.remove(name)
        self._fs(here).mkdirs(here.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs(there), there, self._fs(here), here, False, self.spark._jsc.hadoopConfiguration())

    def remove(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)
