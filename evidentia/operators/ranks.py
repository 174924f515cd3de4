"""Ranks within groups of any size: no task holds a group.

Rows are dealt out in ranges of (group, order); within a range a group's rows stand together and in order. Each range
counts what it has of a group, and the prefix sums of these counts, a few rows a range, turn places in a range into
ranks in the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import workspace
from .catalog import sized_broadcast


def ranked_within(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first of its group in the order given, and the group's size as ``total`` if it is named.

    ``order``: names of columns, with a minus in front for the largest first (nulls last then, else first). As row_number() over a
    window; a null key is a group, and no keys make all rows one group. Rows equal in ``order`` stand in any order, but each once.
    """
    names = [o.lstrip("-") for o in order]
    group = F.struct(F.lit(0).alias("k"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    held = rows.select(F.struct(*rows.columns).alias("r"), group.alias("g"), *(F.col(n).alias(f"o{i}") for i, n in enumerate(names)))
    by = [F.col("g"), *(F.desc(f"o{i}") if o.startswith("-") else F.asc(f"o{i}") for i, o in enumerate(order))]
    dealt = held.repartitionByRange(*by).sortWithinPartitions(*by).select("r", "g", F.monotonically_increasing_id().alias("row"))
    dealt = workspace.written(dealt, "ranges")
    part = F.shiftright("row", 33)
    pieces = dealt.groupBy("g", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("g").alias("its"), F.col("part").alias("own"), "first", before.alias("before"), F.sum("n").over(of).alias("all"))
    out = dealt.join(sized_broadcast(pieces), F.col("g").eqNullSafe(F.col("its")) & (part == F.col("own")))
    return out.select("r.*", (F.col("row") - F.col("first") + F.col("before") + 1).alias(rank), *([F.col("all").alias(total)] if total else []))
