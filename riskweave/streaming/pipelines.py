"""Streaming intake, hourly counts, routing of late rows, and fan-out with receipts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import checkpoint_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros("us")).withWatermark(
        "event_time", delay
    )


def dedup_intake(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeated transaction ids that arrive within the watermark delay."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(["transaction_id"])


def hourly_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Transactions and cents per hour, emitted once an hour is complete."""
    return (
        with_event_time(stream, delay)
        .groupBy(F.window("event_time", "1 hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        .select(F.unix_micros("window.start").alias("hour_us"), "n", "cents")
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk. All stores of an executor share one bounded cache and write buffer; without the
    bound each partition has its own, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Overwrites the batch's own folder, so that a repeated batch leaves no second copy."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def route_late(path: str) -> Callable[[DataFrame, int], None]:
    """Evaluated rows go to one table; rows that arrived late go to a replay table."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            _write_batch(rows.filter("NOT late"), f"{path}/evaluated", batch)
            _write_batch(rows.filter("late"), f"{path}/replay", batch)
        finally:
            rows.unpersist()

    return write


def fan_out(stream: DataFrame, consumer: str, horizon: str = "30 days") -> DataFrame:
    """One receipt per event for a consumer, also when events or batches repeat.

    The event ids recorded within ``horizon`` are keyed state that expires, so a micro-batch costs
    what its own events cost, however many receipts there are.
    """
    published = stream.select(
        F.lit(consumer).alias("consumer_id"), "event_id", F.col("occurred_us").alias("recorded_us")
    )
    timed = published.withColumn("event_time", F.timestamp_micros("recorded_us")).withWatermark("event_time", horizon)
    return timed.dropDuplicatesWithinWatermark(["consumer_id", "event_id"]).drop("event_time")


def run_available(
    result: DataFrame, write: Callable[[DataFrame, int], None] | None = None, state: str | None = None
) -> str:
    """Processes what is there now and returns the output folder. A run that names the ``state`` of
    an earlier one goes on from there."""
    folder = f"{checkpoint_root(result.sparkSession)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    writer = result.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", state or f"{folder}/state"
    )
    if write is None:
        write = lambda rows, batch: _write_batch(rows, out, batch)
    writer.foreachBatch(write).start().awaitTermination()
    return out
