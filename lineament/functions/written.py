"""Tables written to the shared folder and read again: lineage ends there, and a lost executor costs a task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local master, an error on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_lineament_scratch", None):
        sc._lineament_scratch = "file://" + tempfile.mkdtemp(prefix="lineament-scratch-")
    return sc._lineament_scratch


class Written:
    """``df`` reads what was written; ``drop`` removes it, at the end of the program at the latest."""

    left: ClassVar[dict[str, Written]] = {}

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        Written.left[self.path] = self
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        Written.left.pop(self.path, None)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_left() -> None:
    for table in list(Written.left.values()):
        with contextlib.suppress(Exception):
            table.drop()
