"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage as a checkpoint does, survives the loss of an
executor, and is smaller than a checkpoint's rows. The folder is the session's
``spark.checkpoint.dir``; a temporary one is chosen only in local mode.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; without one, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = "file://" + tempfile.mkdtemp(prefix="parchmint-")
        atexit.register(shutil.rmtree, _local[application].removeprefix("file://"), True)
    return _local[application]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it, on its own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation; ``drop`` removes one, the interpreter's end removes the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/parchmint/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            remove(self.spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            pass

    def save(self, df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
        """Write a table and read it back with the same schema.

        Parquet's writer first looks at a row group's size after a hundred rows, and its reader holds a whole group: a table whose
        rows are megabytes each needs ``group_rows``, the most rows of a group.
        """
        writer = df.write.mode("overwrite")
        if group_rows:
            writer = writer.option("parquet.block.row.count.limit", group_rows)
        writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")
