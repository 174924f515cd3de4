"""Streaming forms of the state operators; each gives its batch operator's result once the stream has ended.

Event time is a parameter column; nothing reads a clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day", cap: int = 50) -> DataFrame:
    """T04. Tumbling days: (day, n, admitted). Rows later than the watermark are dropped by Spark."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("day"), "n", F.least(F.col("n"), F.lit(cap)).alias("admitted"))


def sliding_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """T07. Sliding admission windows: (start, n)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """T05. Sessions by inactivity: (key, start, end, n)."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "6 hours") -> DataFrame:
    """T01, T06. The first event of each key; the key is forgotten once the watermark has passed it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest_state(events: DataFrame, key: str, order: str, value: str, retracts: str, days: int = 7, ts: str = "ts") -> DataFrame:
    """T02, T03. Emits a key's state as it changes: (key, order, value, live). ``live`` is false after a retraction, or when
    nothing has come for ``days`` days of event time; then the state is dropped."""
    schema = f"{key} string, {order} long, {value} string, live boolean"

    def update(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = str(k[0])
        if state.hasTimedOut:
            last, body, _ = state.get
            state.remove()
            yield pd.DataFrame([(name, last, body, False)], columns=[key, order, value, "live"])
            return
        last, body, gone = state.get if state.exists else (-1, None, False)
        top = None
        for part in parts:
            row = part.loc[part[order].idxmax()]
            top = max(filter(None, (top, part[ts].max())))
            if row[order] > last:
                last, body, gone = int(row[order]), str(row[value]), bool(row[retracts])
        state.update((last, body, gone))  # a retraction too: an older event may still come
        if top is not None:
            state.setTimeoutTimestamp(max(int(top.timestamp() * 1000) + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(name, last, body, not gone)], columns=[key, order, value, "live"])

    rows = events.withWatermark(ts, f"{days} days").groupBy(F.col(key).cast("string").alias(key))
    return rows.applyInPandasWithState(update, schema, f"{order} long, {value} string, gone boolean", "update", GroupStateTimeout.EventTimeTimeout)
