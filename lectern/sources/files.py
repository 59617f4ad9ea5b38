"""Small files and folders through Hadoop's file systems, so that any store that Spark reads serves."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_mine: set[str] = set()


class Files:
    """The file system that a path lies in."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if it is not there."""
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} cannot become {new}")

    def publish(self, text: str, path: str) -> bool:
        """Put a whole file at ``path`` in one step; False if there is one already."""
        folder, name = path.rsplit("/", 1)
        hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.write(hidden, text)
        try:
            if self.local:  # a rename would replace what is there
                os.link(self._path(hidden).toUri().getPath(), self._path(path).toUri().getPath())
                return True
            keep = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = keep
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(hidden), self._path(path), how)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(hidden)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names; it goes when the driver ends. One of our own only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lectern-scratch-")
    path = f"{where}/scratch-{uuid.uuid4().hex}"
    _mine.add(path)
    if len(_mine) == 1:
        atexit.register(_drop, spark)
    return path


def _drop(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        for path in _mine:
            Files(spark, path).delete(path)
