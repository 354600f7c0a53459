"""Streams with state of their own: analytics held between flushes, and a limit of requests a user.

Both keep little state a key, which ends by timers, and both survive a stop at any time: what was counted
and not yet flushed is in the checkpoint, and is there once when the stream goes on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cotejo.operators.state import EXEMPT, merge_analytics
from cotejo.session import remove

#: Seconds between flushes, and the keys that a stream's events are dealt to.
INTERVAL, SHARDS = 300.0, 8
_HELD = "total long, zero long, latency double, due long"
_FLUSHED = "day string, total_queries long, zero_result_queries long, latency_sum double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state where timers can be kept."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Buffer(StatefulProcessor):
    """Counts of a shard, given out when their time has come or a row says so."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _flushed(self, now: int, total: int, zero: int, latency: float) -> pd.DataFrame:
        day = datetime.fromtimestamp(now / 1000, UTC).date().isoformat()
        return pd.DataFrame({"day": [day], "total_queries": [total], "zero_result_queries": [zero], "latency_sum": [latency]})

    def handleInputRows(self, key, rows, timerValues):
        total, zero, latency, due = self.held.get() if self.held.exists() else (0, 0, 0.0, 0)
        told = False
        for frame in rows:
            events = frame[~frame["flush"].astype(bool)]
            told = told or len(events) < len(frame)
            total, zero, latency = total + len(events), zero + int(events["zero"].sum()), latency + float(events["latency"].sum())
        now = timerValues.getCurrentProcessingTimeInMs()
        if told:
            if due:
                self.handle.deleteTimer(due)
            self.held.clear()
            if total:
                yield self._flushed(now, total, zero, latency)
        elif total:
            if not due:
                due = now + self.wait
                self.handle.registerTimer(due)
            self.held.update((total, zero, latency, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            total, zero, latency, _ = self.held.get()
            self.held.clear()
            yield self._flushed(timerValues.getCurrentProcessingTimeInMs(), total, zero, latency)

    def close(self) -> None:
        pass


def buffered(events: DataFrame, orders: DataFrame, seconds: float = INTERVAL, shards: int = SHARDS) -> DataFrame:
    """Counts of a stream of ``events`` (event_id, zero, latency), some seconds' worth a row, by the day of the flush.

    A stream of ``orders`` (shard) makes a shard give out what it holds at once.
    """
    own = events.select(F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"), F.coalesce("zero", F.lit(False)).alias("zero"), F.coalesce("latency", F.lit(0.0)).alias("latency"), F.lit(False).alias("flush"))
    told = orders.select(F.col("shard").cast("int").alias("shard"), F.lit(False).alias("zero"), F.lit(0.0).alias("latency"), F.lit(True).alias("flush"))
    return own.unionByName(told).groupBy("shard").transformWithStateInPandas(_Buffer(seconds), _FLUSHED, "update", "processingTime")


class Flushing:
    """A daily table under ``path``, kept by flushing a stream's counts every so many seconds and at the end.

    The table has a version for each batch that flushed, made from the one before, so a batch that runs again
    after a failure makes the same version again. ``stop`` flushes what is held.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = INTERVAL, shards: int = SHARDS):
        self.spark, self.path, self.seconds, self.shards = spark, path.rstrip("/"), seconds, shards
        self._orders().limit(0).write.mode("append").parquet(f"{self.path}/orders")

    def _orders(self) -> DataFrame:
        return self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))

    def _system(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """The batches whose table is whole, in order."""
        folder, system = self._system(f"{self.path}/daily")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if system.exists(self._system(f"{self.path}/daily/{n}/_SUCCESS")[0]))

    def _merge(self, batch: DataFrame, number: int) -> None:
        columns = ["day", "total_queries", "zero_result_queries", "latency_sum"]
        batch.persist()  # the state behind a batch is to be run through once
        try:
            if batch.isEmpty():
                return
            before = [n for n in self._versions() if n < number]
            fresh = batch.select(*columns)
            stored = self.spark.read.parquet(f"{self.path}/daily/version={before[-1]}").select(*columns) if before else fresh.limit(0)
            merge_analytics(stored, fresh).write.mode("overwrite").parquet(f"{self.path}/daily/version={number}")
            for old in before[:-1]:
                remove(self.spark, f"{self.path}/daily/version={old}")
        finally:
            batch.unpersist()

    def start(self, events: DataFrame, every: str = "0 seconds") -> StreamingQuery:
        """Runs on until it is stopped; it may be stopped and started again at will."""
        orders = self.spark.readStream.schema("shard int").parquet(f"{self.path}/orders")
        rows = buffered(events, orders, self.seconds, self.shards)
        writer = rows.writeStream.outputMode("update").foreachBatch(self._merge).option("checkpointLocation", f"{self.path}/checkpoint")
        with _with_timers(self.spark):
            return writer.trigger(processingTime=every).start()

    def take(self, events: DataFrame) -> None:
        """Takes what is there, and stops; counts that are not due stay held.

        A query with timers never has nothing to do, so it is stopped after a batch without rows; the
        first batch doesn't count, since it may be one that was planned before a stop.
        """
        query = self.start(events)
        while query.isActive and not any(p["numInputRows"] == 0 for p in query.recentProgress[1:]):
            time.sleep(0.1)
        failed = query.exception()
        query.stop()
        if failed is not None:
            raise failed

    def stop(self, events: DataFrame, query: StreamingQuery | None = None) -> None:
        """Stops the query if there is one, takes the events that are left, and flushes."""
        if query is not None:
            query.stop()
        self._orders().coalesce(1).write.mode("append").parquet(f"{self.path}/orders")
        self.take(events)

    def daily(self) -> DataFrame:
        """The table as it is after the last flush; no rows before the first."""
        done = self._versions()
        if not done:
            return self.spark.createDataFrame([], f"{_FLUSHED}, avg_latency double")
        return self.spark.read.parquet(f"{self.path}/daily/version={done[-1]}")


class _Limit(StatefulProcessor):
    """A user's requests since the first of a window; the window ends so many seconds after it."""

    def __init__(self, most: int, seconds: int, output: list[str]):
        self.most, self.wait, self.output = most, seconds * 1_000_000, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        start, n = self.window.get() if self.window.exists() else (None, 0)
        places = []
        for at in frame["at"].tolist():
            if start is None or at >= start + self.wait:
                start, n = at, 0
            n += 1
            places.append(n)
        self.window.update((start, n))
        self.handle.registerTimer((start + self.wait) // 1000 + 1)
        frame["place"], frame["allowed"] = places, [p <= self.most for p in places]
        yield frame[self.output]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the window that is over, unless another has begun since
        if self.window.exists() and self.window.get()[0] + self.wait < timerValues.getCurrentWatermarkInMs() * 1000:
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, most: int = 100, seconds: int = 60, late: str = "1 hour", exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """Each of a stream of ``requests`` (event_id, user_id, ts) with its place in its user's window, and whether it is allowed.

    A window begins with a user's first request after the last window's end. Exempt users are left
    out. State of users that ask no more is dropped once the watermark has passed their window.
    """
    kind = requests.schema["user_id"].dataType.simpleString()
    rows = requests.where(~F.col("user_id").cast("string").isin(*exempt)).withWatermark("ts", late)
    rows = rows.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    output = ["event_id", "user_id", "place", "allowed"]
    schema = f"event_id long, user_id {kind}, place long, allowed boolean"
    return rows.groupBy("user_id").transformWithStateInPandas(_Limit(most, seconds, output), schema, "append", "eventTime")


def drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """What a stateful stream gives for all that is there, written under ``path``."""
    with _with_timers(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")

