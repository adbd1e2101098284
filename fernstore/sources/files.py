"""Small files of the catalogue, through Spark's own file systems, so that they may lie in any store Spark reads."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; hidden and temporary ones are left out."""
        path = self._path(self.at(folder))
        if not self.fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(path)) if n[0] not in "._")

    def read(self, name: str) -> Any:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return json.loads(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode())
        finally:
            stream.close()

    def write(self, name: str, value: Any, overwrite: bool = True) -> bool:
        """Write a whole file under another name and rename it into place; False if it exists and may not be replaced."""
        target, temporary = self._path(self.at(name)), self._path(self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"))
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self.fs.exists(target):
            if not overwrite:
                self.fs.delete(temporary, False)
                return False
            self.fs.delete(target, False)
        return self.fs.rename(temporary, target)

    def create(self, name: str, content: str = "") -> bool:
        """Create a file; False if it is there already."""
        self.fs.mkdirs(self._path(self.at(name.rpartition("/")[0])))
        try:
            stream = self.fs.create(self._path(self.at(name)), False)
        except Exception:
            return False
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return True

    def text(self, name: str) -> str | None:
        """The content of a small file; None if there is none."""
        try:
            stream = self.fs.open(self._path(self.at(name)))
        except Exception:
            return None
        try:
            return self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def touch(self, name: str) -> None:
        import time

        self.fs.setTimes(self._path(self.at(name)), int(time.time() * 1000), -1)

    def move(self, name: str, to: str) -> bool:
        try:
            return self.fs.rename(self._path(self.at(name)), self._path(self.at(to)))
        except Exception:
            return False

    def age(self, name: str) -> float:
        """Seconds since a file was changed."""
        import time

        return time.time() - self.fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(self.at(name)), True)
