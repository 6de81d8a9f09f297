"""Structured Streaming: converters over a landing folder, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import engine


def convert_stream(spark: SparkSession, folder: str, schema: str, source: str, target: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stream over Parquet files of a folder, converted row by row: stateless, so it scales with the files."""
    return engine.convert(spark.readStream.schema(schema).parquet(folder), source, target, key, text)


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each type an hour; rows later than the watermark are dropped and their state freed."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
