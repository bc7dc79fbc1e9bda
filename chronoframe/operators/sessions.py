"""Windows of time and tracks; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_utc(events: DataFrame, at: str = "ts") -> DataFrame:
    """Events with a timestamp without zone read as UTC."""
    return events.withColumn(at, F.to_utc_timestamp(F.col(at).cast("timestamp"), F.current_timezone()) if dict(events.dtypes)[at] == "timestamp_ntz" else F.col(at))


def tumbling(events: DataFrame, size: str, keys: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    grouped = events.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, at: str = "ts", value: str = "value") -> DataFrame:
    grouped = events.groupBy(F.window(at, size, step).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")


def by_gap(events: DataFrame, key: str, gap: str, at: str = "ts") -> DataFrame:
    grouped = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tracks(df: DataFrame, keys: list[str], order: str, most_missed: int) -> DataFrame:
    """(keys, track, start, end, n): a track ends when its object is missed for more than ``most_missed`` frames."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = F.when(F.col(order) - F.lag(order).over(w) > most_missed, 1).otherwise(0)
    marked = df.withColumn("cut_", cut).withColumn("track", F.sum("cut_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*keys, "track").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
