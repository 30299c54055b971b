"""Small JSON files on the storage that all machines share, replaced in one step."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class SharedFiles:
    """JSON files in a folder of any file system that Spark can reach (local, HDFS, object stores).

    ``put`` writes a new file completely and then renames it over the old one, so a reader
    sees the old or the new content, and a crash in between leaves the old.
    """

    def __init__(self, folder: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("shared files need a running session")
        self.folder = folder.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = root.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), conf)
        self._fs.mkdirs(root)

    def _path(self, name: str):
        return self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json"))

    def get(self, name: str) -> dict | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> None:
        fresh = self._path(f"{name}.new")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
            stream.hsync()
        finally:
            stream.close()
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context.rename(fresh, self._path(name), options)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), False)

    def names(self) -> list[str]:
        """The names that have a file, in order."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.folder))]
        return sorted(n.removesuffix(".json") for n in found if n.endswith(".json") and not n.endswith(".new.json"))

    def folders(self, below: str = "") -> list[tuple[str, float]]:
        """(name, time of the last change) of the folders in ``below``."""
        root = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(root) if s.isDirectory()]

    def remove_folder(self, name: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)
