"""Streams that are stopped at any time give each event once; limits are those of a fold over requests."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cotejo.streaming import stateful


def put(spark, folder, ids):
    """A file of events: every fifth without result, latency equal to the id."""
    spark.createDataFrame([(k, k % 5 == 0, float(k)) for k in ids], "event_id long, zero boolean, latency double").coalesce(1).write.mode("append").parquet(folder)


def events(spark, folder):
    return spark.readStream.schema("event_id long, zero boolean, latency double").parquet(folder)


def totals(flushing):
    row = flushing.daily().agg(F.sum("total_queries"), F.sum("zero_result_queries"), F.sum("latency_sum")).first()
    return tuple(row)


def test_a_killed_stream_gives_each_event_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    flushing = stateful.Flushing(spark, str(tmp_path / "t"), seconds=3600, shards=3)
    assert flushing.daily().count() == 0
    put(spark, folder, range(40))
    flushing.take(events(spark, folder))
    assert totals(flushing) == (None, None, None)  # held, not yet due
    put(spark, folder, range(40, 60))
    query = flushing.start(events(spark, folder), every="1 second")
    deadline = time.time() + 60
    while not any(p["numInputRows"] for p in query.recentProgress) and time.time() < deadline:
        time.sleep(0.2)
    query.stop()  # between flushes
    put(spark, folder, range(60, 75))
    flushing.stop(events(spark, folder))
    assert totals(flushing) == (75, 15, float(sum(range(75))))
    flushing.stop(events(spark, folder))
    assert totals(flushing) == (75, 15, float(sum(range(75))))
    put(spark, folder, range(75, 80))
    flushing.stop(events(spark, folder))
    assert totals(flushing) == (80, 16, float(sum(range(80))))


def test_counts_are_flushed_when_their_time_has_come(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, range(30))
    flushing = stateful.Flushing(spark, str(tmp_path / "t"), seconds=1, shards=2)
    query = flushing.start(events(spark, folder), every="1 second")
    deadline = time.time() + 60
    while totals(flushing)[0] != 30 and time.time() < deadline:
        time.sleep(0.3)
    query.stop()
    assert totals(flushing) == (30, 6, float(sum(range(30))))


@pytest.mark.parametrize("files", [1, 3])
def test_limits_are_those_of_a_fold(spark, tmp_path, files):
    random.seed(4)
    first = datetime(2024, 1, 1)
    rows = sorted((first + timedelta(milliseconds=random.randrange(600_000)), random.choice("aab") if k % 9 else "localhost") for k in range(300))
    rows = [(k, user, at) for k, (at, user) in enumerate(rows)]
    for part in range(files):
        some = rows[part * 100 * (3 // files) : (part + 1) * 100 * (3 // files)] if files > 1 else rows
        spark.createDataFrame(some, "event_id long, user_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema("event_id long, user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["event_id"]: (r["place"], r["allowed"]) for r in stateful.drained(spark, stateful.limited(stream, most=10, seconds=60), str(tmp_path / "out")).collect()}
    expected, windows = {}, {}
    for k, user, at in rows:
        if user == "localhost":
            continue
        start, n = windows.get(user, (None, 0))
        if start is None or at >= start + timedelta(seconds=60):
            start, n = at, 0
        windows[user] = (start, n + 1)
        expected[k] = (n + 1, n + 1 <= 10)
    assert got == expected and not all(a for _, a in expected.values())
