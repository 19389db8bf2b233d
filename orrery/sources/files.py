"""Small files by URI, through the file system classes that Spark itself uses: local, HDFS or object stores alike."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def create(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self.exists() else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write whole, then rename: readers see the file complete or not at all."""
        staged = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(staged), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        if not self._fs.rename(self._path(staged), self._path(name)):
            self._fs.delete(self._path(staged), False)
            raise OSError(f"{self.uri}/{name} could not be published")
