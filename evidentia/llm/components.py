"""Connected components by large-star and small-star rounds, all of it in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node reachable. Each round's table is removed after the next.

    Every round sends each node's larger neighbours to its smallest one, then its
    smaller ones; the edges end as stars. A node with very many neighbours is a
    partial aggregate and a join side that is dealt anew when skewed, never one
    task's list. Loops and nulls link nothing; no edges give no rows.
    """
    now = scratch.written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    last = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u").alias("e").join(low.alias("l"), F.col("e.u") == F.col("l.u"))
            .select(F.col("e.v").alias("u"), F.col("l.m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            large.alias("e").join(low.alias("l"), F.col("e.u") == F.col("l.u"))
            .select(F.col("e.u").alias("x"), F.col("e.v").alias("y"), F.col("l.m").alias("m"))
            .select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        before, now = now, scratch.written(small, "edges")
        scratch.forget(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.countDistinct("v")).first()
        if not mark[0] or mark == last:
            break
        last = mark
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
