"""Event-time counts over a stream, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, by: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their values' sum in each window; rows that come later than ``late`` are left out. Works on tables as well."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n", "total")
