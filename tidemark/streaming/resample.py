"""Streaming resampling of ticks into bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """Ticks (symbol, ts, price, tie) of the events' files, as they come."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tie"))


def resampled(ticks: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of tumbling windows; ticks that are more than ``late`` behind are dropped, and a window is given once it is over by that much."""
    at = F.struct("ts", "tie")
    agg = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length))
    bars = agg.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
