"""Streaming forms of the bar operators. An extension: they keep results current as rows arrive.

All of them are aggregations, which combine before the shuffle in every
micro-batch, so a key with a third of the events is no hot spot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import week_end
from ..session import shared_dir

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet", delay: str = "1 day") -> DataFrame:
    """Event stream of a folder; event time is UTC and watermarked."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files).parquet(folder)
    return raw.withColumn("ts", F.expr("CAST(CAST(ts AS STRING) || 'Z' AS TIMESTAMP)")).withWatermark("ts", delay)


def daily_bars(events: DataFrame) -> DataFrame:
    """OHLCV of the values per user and UTC day."""
    return events.groupBy(F.window("ts", "1 day").alias("day"), F.col("user_id").alias("ticker")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").alias("volume"),
    )


def weekly_last(events: DataFrame) -> DataFrame:
    """Last value per user and Friday week. Weeks are 7-day windows that start on Saturday."""
    week = F.window("ts", "7 days", startTime="2 days").alias("week")  # 1970-01-03 was a Saturday
    return events.groupBy(week, F.col("user_id").alias("ticker")).agg(F.max_by("value", "ts").alias("close"))


def first_per_key(events: DataFrame) -> DataFrame:
    """First event per user, type and day: deduplication as an aggregation."""
    return events.groupBy(F.window("ts", "1 day").alias("day"), "user_id", "event_type").agg(
        F.min_by("event_id", "ts").alias("event_id")
    )


def run_available(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process what is there, then stop; returns the newest result per key.

    Each micro-batch appends its changed rows to a log under the shared folder
    with its number, so a repeated batch after a failure changes nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "batch").alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def bars_table(spark: SparkSession, folder: str) -> DataFrame:
    out = run_available(daily_bars(read_events(spark, folder)), ["day", "ticker"], "stream-bars")
    return out.selectExpr("ticker", "CAST(day.start AS DATE) AS date", "open", "high", "low", "close", "volume")


def weekly_table(spark: SparkSession, folder: str) -> DataFrame:
    out = run_available(weekly_last(read_events(spark, folder)), ["week", "ticker"], "stream-weekly")
    return out.selectExpr("ticker", f"{week_end('CAST(week.start AS DATE)')} AS week_end", "close")


def first_table(spark: SparkSession, folder: str) -> DataFrame:
    out = run_available(first_per_key(read_events(spark, folder)), ["day", "user_id", "event_type"], "stream-first")
    return out.selectExpr("user_id", "event_type", "CAST(day.start AS DATE) AS day", "event_id")
