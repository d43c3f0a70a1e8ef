"""Names on the cluster's file system, through Hadoop's own interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFiles:
    """List and delete below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202 - a JVM object
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names of the entries of a folder; empty when it does not exist."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path))

    def is_dir(self, name: str = "") -> bool:
        path = self._path(name)
        return self._fs.exists(path) and self._fs.getFileStatus(path).isDirectory()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
