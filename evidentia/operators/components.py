"""Connected components by query, in sorted runs of neighbours: no task holds a query's links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import workspace


def components(links: DataFrame) -> DataFrame:
    """(q, node, component) of every node in ``links`` (q, a, b): the smallest node of the same q that it reaches."""
    now = stars(links)
    return now.union(now.select("q", "component", "component").distinct())


def stars(links: DataFrame) -> DataFrame:
    """(q, node, component) of every node that reaches a smaller one of the same q; component: the smallest.

    In each round every node's larger neighbours are linked to its smallest one, then its smaller ones; the links end as stars around
    the smallest nodes, after about as many rounds as the logarithm of the longest path. Each half of a round is one shuffle: a node's
    neighbours stand in order, so the smallest is the first and equal links are neighbours; a window spills those of a node with very many. Rounds are
    written, so lost executors repeat one at most. The last is the one that moves no link. Loops link nothing; nulls aren't nodes.
    """
    w = Window.partitionBy("q", "u").orderBy("v")
    new = ~F.lag("v").over(w).eqNullSafe(F.col("v"))
    first = F.first("v").over(w)
    now = links.where("a <> b and q is not null").select("q", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = workspace.written(now, "links")
    while True:
        both = now.select("q", "u", "v").union(now.select("q", "v", "u"))
        large = both.select("q", "u", "v", F.least(first, "u").alias("m"), new.alias("new")).where("new and v > u")
        large = large.select("q", F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        small = large.select("q", "u", "v", "moved", first.alias("m"), new.alias("new")).where("new")
        least = F.col("v") == F.col("m")
        now = workspace.written(small.select("q", F.when(least, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~least).alias("moved")), "links")
        if now.where("moved").isEmpty():
            return now.select("q", F.col("u").alias("node"), F.col("v").alias("component"))
