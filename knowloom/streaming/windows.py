"""Event-time windows; the same expressions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of windows of `width`; with `late`, a stream drops what is later than that."""
    x = df.withWatermark(ts, late) if late else df
    total = [F.sum(value).alias("total")] if value else []
    return x.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), *total).select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events less than `gap` apart."""
    x = df.withWatermark(ts, late) if late else df
    return x.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
