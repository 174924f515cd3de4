"""Places of rows in a global order, by group, without one task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def placed(rows: DataFrame, group: str, by: list[str]) -> DataFrame:
    """``rows`` with ``at`` (place within the group in the order of ``by``, from 0) and ``total`` (of the group).

    Rows are dealt out in ranges of (group, by), so a group of any size is as many tasks as its rows need. A piece is what a range has
    of a group; pieces, not rows, are counted and summed up. ``group`` must not be null; rows equal in ``by`` stand in any order.
    """
    dealt = rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    return after(scratch.written(dealt.withColumn("row", F.monotonically_increasing_id()), "sorted"), group)


def after(rows: DataFrame, group: str) -> DataFrame:
    """Places of rows that are written in order, with ``row``: the number that monotonically_increasing_id gave them."""
    part = F.shiftright("row", 33)
    pieces = rows.groupBy(group, part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col(group).alias("its"), "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("total")
    )
    out = rows.join(scratch.sized(pieces), (F.col(group) == F.col("its")) & (part == F.col("part")))
    return out.select(*rows.drop("row").columns, (F.col("row") - F.col("first") + F.col("before")).alias("at"), "total")
