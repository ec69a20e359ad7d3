"""Small files beside the tables, through the file system that the path names; exclusive creation decides between writers."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from rootstone.errors import BackendError

#: Seconds after which a claimed name whose file was never written is free again.
ABANDONED_S = 600


class Folder:
    """durable: written files are synced to storage before they are published."""

    def __init__(self, spark: SparkSession, path: str, durable: bool = True) -> None:
        self.spark, self.path, self.durable = spark, path.rstrip("/"), durable
        self._path, self._bytes = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, data: bytes) -> bool:
        """Writes a new file whole; False if the name is taken. The content is written aside and then renamed, so no reader
        sees a part of it, and the name itself is claimed by an exclusive lock file."""
        lock = self._at(f"{name}.lock")
        self._fs.mkdirs(lock.getParent())
        if self._fs.exists(self._at(name)):
            return False
        if self._fs.exists(lock) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > ABANDONED_S:
            self._fs.delete(lock, False)  # its writer died before it wrote
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise BackendError(f"cannot write {name}: {e}") from e
        self.replace(name, data)
        return True

    def replace(self, name: str, data: bytes) -> None:
        aside, target = self._at(f"{name}.part"), self._at(name)
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, True)
        out.write(data)
        if self.durable:
            out.hsync()
        out.close()
        if self._fs.exists(target):
            self._fs.delete(target, False)
        if not self._fs.rename(aside, target):
            raise BackendError(f"cannot publish {name}")

    def read(self, name: str) -> bytes:
        try:
            stream = self._fs.open(self._at(name))
        except Py4JJavaError as e:
            raise BackendError(f"{self.path}/{name} is missing") from e
        try:
            return bytes(self._bytes(stream))
        except Py4JJavaError as e:
            raise BackendError(f"{self.path}/{name} cannot be read: {str(e.java_exception)[:200]}") from e
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._at(to).getParent())
        if not self._fs.rename(self._at(name), self._at(to)):
            raise BackendError(f"cannot move {name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def is_folder(self, name: str) -> bool:
        return self._fs.getFileStatus(self._at(name)).isDirectory()

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
