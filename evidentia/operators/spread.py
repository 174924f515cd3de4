"""Work dealt out by rows: tasks of a stated number of rows, whatever the bytes they come from, and pairs in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import workspace

#: Rows of a task where little is done for each; rows on one side of a block of pairs; rows of a side that every task holds.
ROWS, BLOCK, HELD = 500_000, 1000, 1_000_000


def spread(rows: DataFrame, like: DataFrame, *keys: str, each: int = ROWS) -> DataFrame:
    """``rows`` in as many tasks as ``like`` has times ``each`` rows, by the keys if there are any. ``like`` is a table that has as many rows
    or more and is counted at no cost. Tasks of few bytes aren't joined, so what a task does and holds stays as it is in larger tables."""
    n = -(-max(like.count(), 1) // each)
    return rows.repartition(n, *keys)


def _tasks(rows: DataFrame) -> int:
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def paired(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(a, b): all rows of ``left`` (key, a) with all those of ``right`` (key, b) of the same key, once for each pair of rows.

    Both sides are cut into blocks of about ``BLOCK`` rows of a key. Blocks meet, not rows, and only they are shuffled; each task then
    writes out the pairs of its blocks, one after another.
    """

    def blocks(rows: DataFrame, value: str, name: str) -> DataFrame:
        n = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
        part = F.pmod(F.xxhash64(value), F.col("_n")).alias(f"_{name}")
        return rows.join(n, key).select(key, value, part).groupBy(key, f"_{name}").agg(F.collect_list(F.struct(value)).alias(name))

    met = blocks(left, a, "l").join(blocks(right, b, "r"), key)
    # a stated number: blocks are few bytes for the pairs that they hold
    met = met.repartition(_tasks(met), key, "_l", "_r")
    return met.select(F.explode("l").alias("x"), "r").select("x", F.explode("r").alias("y")).select(f"x.{a}", f"y.{b}")


def matched(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """As ``paired``, several times as fast, where ``right`` has at most ``HELD`` rows: every task holds them by a number of their key, the rows of
    ``left`` are dealt out one by one, and a join writes out the pairs."""
    if not 0 < right.limit(HELD + 1).count() <= HELD:
        return paired(left, right, key, a, b)
    # written once, so that both sides have the same numbers, which are found faster than keys of other kinds
    keys = F.broadcast(workspace.written(right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_k", F.monotonically_increasing_id()), "keys"))
    rows = left.join(keys, key).select("_k", a)
    rows = rows.repartition(_tasks(rows), "_k", a)
    # the rows of a key stand together
    return rows.join(F.broadcast(right.join(keys, key).select("_k", b).repartition("_k")), "_k").select(a, b)
