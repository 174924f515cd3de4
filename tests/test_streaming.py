"""Streams give what the batch operators give, once all rows are in."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentia.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id string, value string, retracts boolean"


def events(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=37 * i), f"u{i % 3}", f"v{i}", i % 7 == 0) for i in range(100)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.coalesce(1).write.mode("overwrite").json(str(folder))
    return batch, spark.readStream.schema(SCHEMA).json(str(folder))


def collect(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_daily_counts(spark, tmp_path):
    batch, stream = events(spark, tmp_path / "e")
    got = {r.day: r.n for r in collect(spark, state.daily_counts(stream), "daily", "complete").collect()}
    want = {r.day: r.n for r in batch.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sliding_counts(spark, tmp_path):
    batch, stream = events(spark, tmp_path / "e")
    got = {r.start: r.n for r in collect(spark, state.sliding_counts(stream), "sliding", "complete").collect()}
    want = {r.w.start: r.n for r in batch.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sessions(spark, tmp_path):
    batch, stream = events(spark, tmp_path / "e")
    got = {(r.user_id, r.start): r.n for r in collect(spark, state.sessions(stream, "user_id", gap="2 hours"), "sess", "complete").collect()}
    want = {(r.user_id, r.w.start): r.n for r in batch.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_latest_state(spark, tmp_path):
    batch, stream = events(spark, tmp_path / "e")
    out = collect(spark, state.latest_state(stream, "user_id", "event_id", "value", "retracts"), "latest", "update")
    got = {r.user_id: (r.event_id, r.live) for r in out.groupBy("user_id").agg(F.max_by(F.struct("event_id", "live"), "event_id").alias("r")).select("user_id", "r.*").collect()}
    from evidentia.operators.memory import latest

    live = {r.user_id: r.event_id for r in latest(batch, ["user_id"], "event_id", "retracts").collect()}
    assert {k: v for k, (v, ok) in got.items() if ok} == live


def test_first_seen(spark, tmp_path):
    batch, stream = events(spark, tmp_path / "e")
    got = collect(spark, state.first_seen(stream, ["user_id"], late="90 days"), "first", "append").count()
    assert got == batch.select("user_id").distinct().count()


def test_a_retraction_outlives_its_trigger(spark, tmp_path):
    """An older event that comes in a later trigger doesn't bring a retracted key back."""
    start = datetime(2024, 1, 1)
    rows = [[(9, start + timedelta(hours=9), "u", "last", True)], [(3, start + timedelta(hours=3), "u", "old", False)], [(12, start + timedelta(hours=12), "u", "new", False)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("overwrite").json(str(tmp_path / f"e{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "e*"))
    out = state.latest_state(stream, "user_id", "event_id", "value", "retracts")
    q = out.writeStream.format("memory").queryName("retracted").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_id, r.live) for r in spark.table("retracted").collect()] == [(9, False), (9, False), (12, True)]
