"""Streaming jobs that stop, crash and go on."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pagequarry.operators import repair
from pagequarry.streaming import incremental
from pyspark.sql import functions as F

SCHEMA = "user_id long, event_id long, ts timestamp, score long, interaction long, keyboard_broken boolean"


def rows(first, last, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    every = [(rng.randrange(6), i, start + dt.timedelta(minutes=i), rng.randrange(60, 99), rng.randrange(26), rng.random() < 0.2) for i in range(last)]
    return every[first:]


def put(spark, path, part, first, last):
    spark.createDataFrame(rows(first, last), SCHEMA).coalesce(1).write.parquet(f"{path}/{part}")


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_latest_rows_survive_restarts(spark, tmp_path):
    at, data = str(tmp_path / "job"), str(tmp_path / "in")
    put(spark, data, "a", 0, 40)
    incremental.upsert_latest(source(spark, data), ["user_id"], "event_id", at)
    put(spark, data, "b", 40, 60)
    put(spark, data, "c", 60, 90)
    got = {r.user_id: r.event_id for r in incremental.upsert_latest(source(spark, data), ["user_id"], "event_id", at).collect()}
    want = {}
    for u, e, *_ in rows(0, 90):
        want[u] = max(e, want.get(u, -1))
    assert got == want
    again = {r.user_id: r.event_id for r in incremental.upsert_latest(source(spark, data), ["user_id"], "event_id", at).collect()}
    assert again == want, "a start without new files changes nothing"
    first = {r.user_id: r.event_id for r in incremental.first_seen(source(spark, data), ["user_id"], "event_id", str(tmp_path / "first")).collect()}
    assert first == {u: min(e for v, e, *_ in rows(0, 90) if v == u) for u in want}


def test_a_crash_between_rows_and_manifest_is_made_good(spark, tmp_path, monkeypatch):
    at, data = str(tmp_path / "job"), str(tmp_path / "in")
    put(spark, data, "a", 0, 40)
    put(spark, data, "b", 40, 90)
    real, calls = type(spark).createDataFrame, []

    def fails(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(spark), "createDataFrame", fails)
    with pytest.raises(Exception, match="killed"):
        incremental.upsert_latest(source(spark, data), ["user_id"], "event_id", at)
    monkeypatch.undo()
    got = {r.user_id: r.event_id for r in incremental.upsert_latest(source(spark, data), ["user_id"], "event_id", at).collect()}
    assert got == {u: max(e for v, e, *_ in rows(0, 90) if v == u) for u in {r[0] for r in rows(0, 90)}}


def test_early_stops_go_on_over_restarts(spark, tmp_path):
    at, data = str(tmp_path / "job"), str(tmp_path / "in")
    run = lambda: incremental.upsert(incremental.early_stops(source(spark, data)), ["user_id"], F.max_by, F.col("iterations"), at, "update")
    put(spark, data, "a", 0, 30)
    run()
    put(spark, data, "b", 30, 50)
    put(spark, data, "c", 50, 120)
    got = {r.user_id: (r.reason, r.stopped_at, r.best) for r in run().collect()}
    batch = spark.createDataFrame(rows(0, 120), SCHEMA).select(F.col("user_id").alias("record_id"), F.col("event_id").alias("iteration"), "score", "interaction", "keyboard_broken")
    assert got == {r.record_id: (r.stop_reason, r.stopped_at, r.best_score) for r in repair.replay(batch).collect()}


def test_late_rows_leave_closed_windows(spark, tmp_path):
    data, at = str(tmp_path / "in"), str(tmp_path / "job")
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    for name, hours in (("a", [0, 1, 9]), ("b", [8]), ("c", [0, 10])):
        spark.createDataFrame([(base + dt.timedelta(hours=h), "k", 5) for h in hours], "ts timestamp, event_type string, cents long").coalesce(1).write.parquet(f"{data}/{name}")
    stream = spark.readStream.schema("ts timestamp, event_type string, cents long").option("maxFilesPerTrigger", 1).parquet(f"{data}/*")
    table = incremental.upsert(incremental.tumbling(stream), ["start", "event_type"], F.max_by, F.col("n"), at, "update")
    assert {(r.start.hour, r.n) for r in table.select(F.col("start").cast("timestamp_ntz").alias("start"), "n").collect()} == {(0, 1), (1, 1), (9, 1), (8, 1), (10, 1)}
