"""Streaming counts: the frequency operators over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.frequency import bin_index


def read_events(spark: SparkSession, path: str, schema: T.StructType, *, glob: str | None = None, time_col: str = "ts") -> DataFrame:
    """A stream of Parquet files whose time column is a timestamp (watermarks don't take timestamp_ntz)."""
    r = spark.readStream.schema(schema)
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.parquet(path).withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(stream: DataFrame, key: str, *, time_col: str = "ts", window: str = "1 day", late: str = "1 hour", weight: str | None = None) -> DataFrame:
    """Counts (or sums of ``weight``) by window and key; rows later than ``late`` are left out."""
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(agg.alias("freq"))


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Counts over all time, for complete or update mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("freq"))


def running_histogram(stream: DataFrame, value: str, n_bins: int, low: float, high: float) -> DataFrame:
    """Counts by bin over all time (bins without rows are not in the stream's result)."""
    return stream.where(F.col(value).isNotNull()).groupBy(bin_index(F.col(value), n_bins, low, high).alias("bin")).agg(F.count(F.lit(1)).alias("freq"))
