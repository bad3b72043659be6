"""Tables that are made once: for one run in the shared folder, or by key for all runs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachwell.guards import CatchmentError


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise CatchmentError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="reachwell-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, with nothing before it to repeat."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables by name and key under one folder, each made when it is first asked for.

    A key names what the table depends on, such as a vintage, a year and a
    resolution. A table counts as there once its writing has ended.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str, key: dict[str, object]) -> str:
        parts = [name, *(f"{k}={v}" for k, v in sorted(key.items()))]
        for p in parts:
            if not re.fullmatch(r"[\w.+-]+(=[\w.+-]+)?", p):
                raise CatchmentError(f"{p!r} can't be part of a table's name")
        return "/".join([self.folder, *parts, "table"])

    def _files(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def holds(self, name: str, **key: object) -> bool:
        files, at = self._files(self._path(name, key) + "/_SUCCESS")
        return files.exists(at)

    def table(self, name: str, build: Callable[[], DataFrame], **key: object) -> DataFrame:
        """The table, from ``build`` only if it isn't there yet or was not written to its end."""
        path = self._path(name, key)
        if not self.holds(name, **key):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def release(self, name: str, **key: object) -> bool:
        """Deletes the table of the key; whether there was one."""
        files, at = self._files(self._path(name, key))
        return files.delete(at, True)
