"""Streams of events binned on the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def time_bins(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, c, n, least, most): tumbling windows; works on streams (with a watermark) and on tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "c", "n", "least", "most")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
