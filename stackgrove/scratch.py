"""Tables of one run in a folder that all executors share; a written table cuts the lineage and outlives executors."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="stackgrove-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, one of its own in local mode and an error on a cluster."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or _own_dir(context.applicationId)).rstrip("/")


#: Folders to remove when the driver's Python ends, with the Java path and file system settings of each.
_folders: dict[str, tuple] = {}


@atexit.register
def _remove_folders() -> None:
    for root in list(_folders):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _remove(*_folders.pop(root))


def _remove(path, settings) -> None:
    path.getFileSystem(settings).delete(path, True)


class Scratch:
    """Tables of one run in the shared folder; a table cuts the lineage and outlives executors.

    A step drops the tables that no later one reads; the rest goes when the driver's Python ends, as results
    read them when they are asked for.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _folders[self.root] = self._java(self.root)

    def _java(self, path: str) -> tuple:
        context = self.spark.sparkContext
        return context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            _remove(*self._java(self.path(name)))

    def clear(self) -> None:
        """Removes all tables, once nothing reads them."""
        _remove(*_folders.pop(self.root))
