"""Query analytics on a stream of events: windows of five minutes, and a daily table kept by merging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cotejo.operators.state import merge_analytics, query_analytics
from cotejo.session import cut, exists, remove, shared_dir

WINDOW, LATE = "5 minutes", "1 hour"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Events of a folder of Parquet files as a stream; ts becomes a timestamp, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """Events, events of type error and the sum of values per window; later ones than ``late`` are dropped."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    sums = counted.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("value_sum"))
    return sums.select(F.col("w.start").alias("window_start"), "events", "errors", "value_sum")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there as Parquet and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_daily(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of events into the daily table under ``path``.

    A batch is written as a version named by its number, from the version before it; a batch that
    is run again after a failure writes the same version again, so nothing is counted twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = query_analytics(batch, F.to_date("ts"), "value", "event_id")
        stored = spark.read.parquet(f"{path}/version={number - 1}").drop("avg_latency") if number else fresh.limit(0)
        merge_analytics(stored, fresh).write.mode("overwrite").parquet(f"{path}/version={number}")

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp."""
    folder = f"{sf_dir}/events.parquet"
    source = spark.read.parquet(folder)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet")
    events = stream.parquet(folder if _is_folder(spark, folder) else f"{sf_dir}/events*.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def keep_windows(events: DataFrame, path: str, checkpoint: str) -> str:
    """Keeps the windows of a stream under a path, and gives the folder of the last version.

    Each batch gives the windows that it changed, and they take the place of their former rows in a new
    version, made from the one before. State is kept for windows that the watermark has not passed.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch.persist()  # the state behind a batch is to be run through once
        try:
            spark = batch.sparkSession
            before = [n for n in range(number - 1, -1, -1) if exists(spark, f"{path}/version={n}/_SUCCESS")][:1]
            rows = batch
            if before:
                rows = spark.read.parquet(f"{path}/version={before[0]}").join(batch.select("window_start"), "window_start", "left_anti").unionByName(batch)
            rows.write.mode("overwrite").parquet(f"{path}/version={number}")
            for old in range(max(0, number - 2)):
                remove(spark, f"{path}/version={old}")
        finally:
            batch.unpersist()

    query = windowed(events).writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/version={query.lastProgress['batchId']}"


def windows_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the events table, made by a stream."""
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    rows = spark.read.parquet(keep_windows(events_of(spark, sf_dir), f"{base}/result", f"{base}/checkpoint"))
    done = cut(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
    remove(spark, base)
    return done


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
