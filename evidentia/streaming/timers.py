"""State with timers: caches, retention, bounded caches and idle runs as streams, by transformWithState.

Each emits a log of changes; the last row of a key in it is what the batch operator of the same name gives for ``now``
at the stream's last watermark. Timers are of event time, so a replay gives the same log. A late row (older than
what its key has seen) changes nothing that a newer one has set. RocksDB holds the state, so keys need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class _Timed(StatefulProcessor):
    """A processor that keeps one timer a key: for the earliest time that anything of it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _wake(self, ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if ms is not None:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class _Cache(_Timed):
    """T01. The last write of a key, until its time to live has passed."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts timestamp, id long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = self.last.get() if self.last.exists() else None
        for part in rows:
            for ts, i, value in part[["ts", "id", "value"]].itertuples(index=False):
                if own is None or (pd.Timestamp(ts), int(i)) > (pd.Timestamp(own[0]), int(own[1])):
                    own = (pd.Timestamp(ts).to_pydatetime(), int(i), value)
        ends = _ms(own[0]) + self.ttl
        live = ends > timerValues.getCurrentWatermarkInMs()
        if live:
            self.last.update(own)
            self._wake(ends)
        else:
            self.last.clear()
        yield pd.DataFrame([(key[0], own[0], own[2], live)], columns=["key", "ts", "value", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            own = self.last.get()
            if _ms(own[0]) + self.ttl <= timerValues.getCurrentWatermarkInMs():
                self.last.clear()
                yield pd.DataFrame([(key[0], own[0], own[2], False)], columns=["key", "ts", "value", "live"])


def cache(writes: DataFrame, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """T01. A log (key, ts, value, live) of a cache's entries. writes: key, ts, id, value (strings but ts and id)."""
    rows = writes.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(_Cache(ttl_seconds * 1000), "key string, ts timestamp, value string, live boolean", "Update", "EventTime")


class _Log(_Timed):
    """T02. The events of a key that are not older than what is kept."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.events = handle.getMapState("events", "id long", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out, first = timerValues.getCurrentWatermarkInMs(), [], None
        for part in rows:
            for ts, i in part[["ts", "id"]].itertuples(index=False):
                live = _ms(ts) + self.keep >= now
                if live:
                    self.events.updateValue((int(i),), (pd.Timestamp(ts).to_pydatetime(),))
                    first = min(x for x in (first, _ms(ts)) if x is not None)
                out.append((key[0], int(i), ts, live))
        held = [t[0] if not isinstance(t, int) else t for t in self.handle.listTimers()]
        ends = [x for x in (first + self.keep + 1 if first is not None else None, *held) if x is not None]
        if ends:
            self._wake(min(ends))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gone, rest = timerValues.getCurrentWatermarkInMs(), [], []
        for i, ts in list(self.events.iterator()):
            (gone if _ms(ts[0]) + self.keep < now else rest).append((i[0], ts[0]))
        for i, _ in gone:
            self.events.removeKey((i,))
        if rest:
            self._wake(min(_ms(t) for _, t in rest) + self.keep + 1)
        yield pd.DataFrame([(key[0], i, t, False) for i, t in gone], columns=["key", "id", "ts", "live"])


def retention(events: DataFrame, keep_seconds: int, late: str = "1 hour") -> DataFrame:
    """T02. A log (key, id, ts, live) of events, each dropped once it is older than what is kept. events: key, id, ts."""
    rows = events.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(_Log(keep_seconds * 1000), "key string, id long, ts timestamp, live boolean", "Update", "EventTime")


class _Plans(_Timed):
    """T06. The latest plans of an owner, ``most`` of them: the oldest makes room for a new one."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.plans = handle.getMapState("plans", "plan string", "ts timestamp, id long, value string")

    def _dropped(self, now: int) -> list[tuple]:
        """Takes out what is too old or beyond ``most``, and sets the timer by what is left."""
        held = sorted(((v[0], int(v[1]), k[0], v[2]) for k, v in self.plans.iterator()), reverse=True)
        kept = [x for x in held if _ms(x[0]) + self.ttl >= now][: self.most]
        gone = [x for x in held if x not in kept]
        for x in gone:
            self.plans.removeKey((x[2],))
        self._wake(min(_ms(x[0]) for x in kept) + self.ttl + 1 if kept else None)
        return gone

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wrote = {}
        for part in rows:
            for plan, ts, i, value in part[["plan", "ts", "id", "value"]].itertuples(index=False):
                own = self.plans.getValue((plan,)) if self.plans.containsKey((plan,)) else None
                if own is None or (pd.Timestamp(ts), int(i)) > (pd.Timestamp(own[0]), int(own[1])):
                    self.plans.updateValue((plan,), (pd.Timestamp(ts).to_pydatetime(), int(i), value))
                    wrote[plan] = (ts, value)
        gone = {x[2]: x for x in self._dropped(timerValues.getCurrentWatermarkInMs())}
        out = [(key[0], p, ts, value, True) for p, (ts, value) in wrote.items() if p not in gone] + [(key[0], p, x[0], x[3], False) for p, x in gone.items()]
        yield pd.DataFrame(out, columns=["owner", "plan", "ts", "value", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = self._dropped(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([(key[0], x[2], x[0], x[3], False) for x in gone], columns=["owner", "plan", "ts", "value", "live"])


def plan_cache(writes: DataFrame, ttl_seconds: int, most: int, late: str = "1 hour") -> DataFrame:
    """T06. A log (owner, plan, ts, value, live) of a bounded cache by owner. writes: owner, plan, ts, id, value."""
    rows = writes.withWatermark("ts", late).groupBy("owner")
    return rows.transformWithStateInPandas(_Plans(ttl_seconds * 1000, most), "owner string, plan string, ts timestamp, value string, live boolean", "Update", "EventTime")


class _Run(_Timed):
    """T08. A run's last step; without a further one for the idle time it is interrupted."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts timestamp, id long, ends boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = self.last.get() if self.last.exists() else None
        for part in rows:
            for ts, i, ends in part[["ts", "id", "ends"]].itertuples(index=False):
                if own is None or (pd.Timestamp(ts), int(i)) > (pd.Timestamp(own[0]), int(own[1])):
                    own = (pd.Timestamp(ts).to_pydatetime(), int(i), bool(ends))
        self.last.update(own)
        idle = _ms(own[0]) + self.idle <= timerValues.getCurrentWatermarkInMs()
        self._wake(None if own[2] or idle else _ms(own[0]) + self.idle)
        yield pd.DataFrame([(key[0], own[0], "finished" if own[2] else "interrupted" if idle else "running")], columns=["run", "ts", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self.last.get()
        if not own[2] and _ms(own[0]) + self.idle <= timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame([(key[0], own[0], "interrupted")], columns=["run", "ts", "state"])


def run_states(steps: DataFrame, idle_seconds: int, late: str = "1 hour") -> DataFrame:
    """T08. A log (run, ts, state) of runs. steps: run, ts, id, ends."""
    rows = steps.withWatermark("ts", late).groupBy("run")
    return rows.transformWithStateInPandas(_Run(idle_seconds * 1000), "run string, ts timestamp, state string", "Update", "EventTime")
