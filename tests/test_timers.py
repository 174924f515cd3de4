"""Streams with timers against their batch operators at the stream's last watermark; late rows and rows that come again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import memory, web
from evidentia.operators.relations import cached_plans
from evidentia.streaming import timers

START = datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp, value string, ends boolean"
#: In five parts: late rows (an hour back and more), a key written again after it ended, one that ends, one that never goes on.
PARTS = [
    [("a", 1, 0, "a1", False), ("b", 2, 10, "b1", False), ("c", 3, 20, "c1", False)],
    [("a", 4, 100, "a2", False), ("a", 5, 95, "a late", False), ("d", 6, 110, "d1", False), ("c", 7, 115, "c2", True)],
    [("b", 8, 400, "b2", False), ("e", 9, 405, "e1", False)],
    [("a", 10, 900, "a3", False), ("f", 11, 905, "f1", False), ("g", 12, 910, "g1", False)],
    [("h", 13, 960, "h1", False), ("f", 14, 915, "f2", True)],
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    rows = [[(k, i, START + timedelta(minutes=m), v, e) for k, i, m, v, e in part] for part in PARTS]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(folder / f"p{n}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark.createDataFrame([r for part in rows for r in part], SCHEMA), lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "p*"))
    spark.conf.unset(key)


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).withColumn("n", F.monotonically_increasing_id())


def now(spark, minutes=900):
    """The last watermark: an hour before the latest row."""
    return spark.createDataFrame([(START + timedelta(minutes=minutes),)], "now timestamp")


def last(log, *keys):
    rest = [c for c in log.columns if c not in (*keys, "n")]
    out = {}
    for r in log.orderBy("n").collect():
        out[tuple(r[k] for k in keys)] = tuple(r[c] for c in rest)
    return out


def test_a_cache_with_time_to_live(spark, source):
    batch, stream = source
    log = last(run(spark, timers.cache(stream().select("key", "ts", "id", "value"), 6 * 3600), "cache"), "key")
    want = {(r.key,): (r.ts, r.value) for r in memory.live_entries(batch.select("key", "ts", "id", "value"), "6 HOURS", now(spark)).collect()}
    assert {k: v[:2] for k, v in log.items() if v[2]} == want and ("d",) in log and ("d",) not in want


def test_retention_of_events(spark, source):
    batch, stream = source
    log = last(run(spark, timers.retention(stream().select("key", "id", "ts"), 10 * 3600), "retention"), "id")
    kept = {r.id for r in memory.retained(batch, "10 HOURS", now(spark)).collect()}
    assert {k[0] for k, v in log.items() if v[-1]} == kept and 0 < len(kept) < 14


def test_a_bounded_cache_of_plans(spark, source):
    batch, stream = source
    rows = stream().select(F.lit("o").alias("owner"), F.col("key").alias("plan"), "ts", "id", "value")
    log = last(run(spark, timers.plan_cache(rows, 12 * 3600, 4), "plans"), "owner", "plan")
    ntz = batch.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "id", "value")
    want = {r.key: r.value for r in cached_plans(ntz, "12 HOURS", 4, "2024-01-02 00:00:00").collect()}
    assert {k[1]: v[1] for k, v in log.items() if v[-1]} == want and len(want) == 4


def test_idle_runs_are_interrupted(spark, source):
    batch, stream = source
    log = last(run(spark, timers.run_states(stream().select(F.col("key").alias("run"), "ts", "id", "ends"), 4 * 3600), "runs"), "run")
    want = {(r.run,): (r.ts, r.state) for r in memory.run_states(batch.select(F.col("key").alias("run"), "ts", "id", "ends"), "4 HOURS", now(spark)).collect()}
    assert log == want and {v[1] for v in want.values()} == {"finished", "interrupted", "running"}


def test_releases_readmit_calls(spark, monkeypatch):
    """The quota's counter against a plain loop, in runs of few events and of many, with days of their own."""
    rows = [(i, START + timedelta(minutes=7 * (i // 2)), i % 5 == 3 or 200 < i < 230) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, gone boolean").repartition(5)
    want, used, day = {}, 0, None
    for i, ts, gone in rows:
        if ts.date() != day:
            used, day = 0, ts.date()
        admitted = None if gone else used < 20
        used = max(used - 1, 0) if gone else min(used + 1, 20)
        want[i] = (used, admitted)
    assert any(want[i][1] for i in range(300) if i > 150) and any(x[1] is False for x in want.values())
    for steps in (1024, 3):
        monkeypatch.setattr(web, "STEPS", steps)
        got = {r.id: (r.used, r.admitted) for r in web.quota(df, "ts", "id", 20, releases=F.col("gone")).collect()}
        assert got == want
