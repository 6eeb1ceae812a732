"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .signals import from_table

#: Seconds between samples of the signals made from events.
STEP = 0.0002


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_signal(spark: SparkSession, folder: str, series: str = "event_type") -> DataFrame:
    """events as signals by event type (or another column), on a clock of STEP seconds."""
    return from_table(read_table(spark, folder, "events").select(series, "event_id", "value"), series, "event_id", "value", STEP)
