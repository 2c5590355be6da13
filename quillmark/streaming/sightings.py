"""Sightings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY = "id long, first_seen timestamp_ntz, last_seen timestamp_ntz, times_seen long, category string"


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sightings of each category in event-time windows; later rows than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "category").agg(F.count("*").alias("n"))
