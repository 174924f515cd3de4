"""Folders for what queries write: below ``spark.checkpoint.dir``, which all executors share; a temporary one only where it is unset."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@atexit.register
def _leave() -> None:
    """Removes this driver's folders when it ends, through the store's own file system, if its session still runs."""
    sc = SparkContext._active_spark_context
    while sc and _made:
        path = sc._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def new(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="workspace-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back, so that what is read several times is computed once, whichever executors are lost."""
    at = new(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
