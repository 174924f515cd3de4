"""Tables that cut lineage, in the folder which the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and all of Spark is one process. On a cluster without the setting this raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, as rows here are whole texts; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: an executor lost later costs no recomputation.

    A frame without rows comes back with its schema.
    """
    spark = df.sparkSession
    at = path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the rest by ``clear``."""
    made = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def lasting(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is left there: for files that are a result."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of these bytes in the shared folder, written through the store's own file system; removed with the rest by ``clear``.
    A name stands for its contents, and is written once."""
    at = f"{folder(spark)}/{name}"
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    if at not in made:
        sc = spark.sparkContext
        jp = sc._jvm.org.apache.hadoop.fs.Path(at)
        out = jp.getFileSystem(sc._jsc.hadoopConfiguration()).create(jp, True)
        out.write(bytearray(data))
        out.close()
        made.append(at)
    return at


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to be none of ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` named by their place, so that no name of an operator's can clash, and what names them back (and drops others)."""
    names = docs.columns
    plain = [c if c in own else f"column{i}" for i, c in enumerate(names)]
    return docs.toDF(*plain), lambda out: out.select(*plain).toDF(*names)


def forget(df: DataFrame) -> None:
    """Removes the folders of a table that ``written`` made and nothing will read again."""
    spark = df.sparkSession
    made = _made.get(spark.sparkContext.applicationId, [])
    for f in df.inputFiles():
        for at in [m for m in made if f.startswith(m + "/") or f.split(":", 1)[-1].lstrip("/").startswith(m.split(":", 1)[-1].lstrip("/") + "/")]:
            drop(spark, at)
            made.remove(at)


def drop(spark: SparkSession, *where: str) -> None:
    """Removes folders through Hadoop's own file system layer, so that any store works."""
    sc = spark.sparkContext
    for p in where:
        jp = sc._jvm.org.apache.hadoop.fs.Path(p)
        jp.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jp, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables of this session; frames built on them can't be read afterwards."""
    drop(spark, *_made.pop(spark.sparkContext.applicationId, []))


@atexit.register
def _leave() -> None:
    """Removes this driver's tables when it ends, if its session still runs."""
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    if spark and spark.sparkContext.applicationId in _made:
        clear(spark)


#: Rows of a side that may be broadcast.
SIDE = 100_000


def sized(side: DataFrame) -> DataFrame:
    """The side with a broadcast hint if it has ``SIDE`` rows at most, counted; else as it is."""
    return F.broadcast(side) if side.limit(SIDE + 1).count() <= SIDE else side


BITS = 1 << 24


def id_bitmap(ids: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of fixed size (``bits`` / 8 bytes, 2 MB) over hashed ids.

    It only lets through a superset of the ids: a set bit may be another id's.
    However many ids there are, at most ``bits`` / 64 rows reach the driver.
    """
    return slot_bitmap(ids.select(id_slot(column, bits)), bits)


def slot_bitmap(slots: DataFrame, bits: int = BITS) -> np.ndarray:
    """The same of slots, numbers below ``bits``, in the only column."""
    rows = (
        slots.toDF("h")
        .groupBy((F.shiftrightunsigned("h", 6)).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("m"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return out


def id_slot(column: str, bits: int = BITS):
    """The column to test against the bitmap."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63)) & 1 == 1
