"""A folder of artifacts on any file system that the cluster can reach, by its URI."""

from __future__ import annotations

import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from .artifacts import META_LIMIT

#: Seconds after which a lock counts as left behind.
STALE_LOCK = 3600


class Store:
    """Small files and folders below one URI; a path without a scheme is one of this machine."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.root = str(folder) if "://" in str(folder) or str(folder).startswith("file:") else Path(folder).resolve().as_uri()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = spark._jvm.org.apache.commons.io.IOUtils.toString

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.uri(name)))

    def read(self, name: str) -> str | None:
        """A small text; None where there is none, or it is too large."""
        path = self._path(self.uri(name))
        if not self._fs.exists(path) or self._fs.getFileStatus(path).getLen() > META_LIMIT:
            return None
        stream = self._fs.open(path)
        try:
            return self._read(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so that a half-written text is never read."""
        new = self._path(self.uri(f".{name}.new"))
        self._put(new, text, True)
        self._fs.delete(self._path(self.uri(name)), False)
        self._fs.rename(new, self._path(self.uri(name)))

    def _put(self, path, text: str, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.uri(name)), True)

    @contextmanager
    def lock(self, wait: float = 600.0):
        """One writer at a time: the lock is a file that only one process can create."""
        path, began = self._path(self.uri(".lock")), time.time()
        while True:
            try:
                self._put(path, str(began), False)
                break
            except Exception as e:  # noqa: BLE001 - the JVM's class for an existing file differs by file system
                if not self._fs.exists(path):
                    raise
                if time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > STALE_LOCK:
                    self._fs.delete(path, False)
                elif time.time() - began > wait:
                    raise TimeoutError(f"{self.root} is locked") from e
                else:
                    time.sleep(0.2)
        try:
            yield
        finally:
            self._fs.delete(path, False)
