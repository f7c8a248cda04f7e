"""Landed JSON files as a stream: parsed, freed of repeats, counted by month.

An extension: the inventory has only monthly slices, cursors and ordered timelines, which these continue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landed(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines that land in a folder, at most `files` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def first_seen(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One row per identity key. State is kept for `delay`, so it stays bounded; a repeat later than that passes."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(rows: DataFrame, ts: str, group: str) -> DataFrame:
    """Counts by day window and group; months are sums of days."""
    return rows.groupBy(F.window(ts, "1 day"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), group, "n")
