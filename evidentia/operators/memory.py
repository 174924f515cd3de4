"""Event logs: latest state, caches, retention, interrupted runs, bounded logs.

``now`` is a parameter or a column's largest value: no clock is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: str, retracts: str | None = None) -> DataFrame:
    """W15, T03. The last event of each key, unless it retracts the key. A partial aggregate: a hot key is one row per task."""
    rest = [c for c in events.columns if c not in keys]
    out = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")
    return out.where(~F.coalesce(F.col(retracts), F.lit(False))) if retracts else out


def bounded_log(events: DataFrame, keys: list[str], order: str, most: int = 1000) -> DataFrame:
    """W16. The last ``most`` events of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def live_entries(writes: DataFrame, ttl: str, now: DataFrame) -> DataFrame:
    """T01. (key, ts, value): what a cache holds at ``now`` (one row, one column): the last write of each key, unless it is ``ttl`` old or older.
    writes: key, ts, id, value; ties by id."""
    last = writes.groupBy("key").agg(F.max(F.struct("ts", "id", "value")).alias("e")).select("key", "e.ts", "e.value")
    return last.crossJoin(F.broadcast(now.toDF("_now"))).where(F.col("ts") + F.expr(f"INTERVAL {ttl}") > F.col("_now")).drop("_now")


def retained(events: DataFrame, keep: str, now: DataFrame) -> DataFrame:
    """T02. Events (ts, ...) that are not older than ``keep`` at ``now`` (one row, one column)."""
    return events.crossJoin(F.broadcast(now.toDF("_now"))).where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {keep}")).drop("_now")


def run_states(steps: DataFrame, idle: str, now: DataFrame) -> DataFrame:
    """T08. (run, ts, state): finished if a run's last step ends it, interrupted if nothing has come for ``idle`` or longer at ``now`` (one
    row, one column), else running. steps: run, ts, id, ends (boolean); ties by id."""
    last = steps.groupBy("run").agg(F.max(F.struct("ts", "id", "ends")).alias("e")).select("run", "e.ts", "e.ends")
    rows = last.crossJoin(F.broadcast(now.toDF("_now")))
    idle_now = F.col("ts") + F.expr(f"INTERVAL {idle}") <= F.col("_now")
    return rows.select("run", "ts", F.when(F.col("ends"), "finished").when(idle_now, "interrupted").otherwise("running").alias("state"))
