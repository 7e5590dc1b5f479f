"""Ticks to bars and bars to wider bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.clock import WIDTHS


def _frame(ts: str, tf: str) -> Column:
    return F.window(ts, f"{WIDTHS[tf]} seconds")


def to_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """OHLCV bars; equal timestamps are ordered by tick_id.

    Partial aggregation runs before the shuffle, so a hot symbol sends one row per
    bar and input split.
    """
    order = F.struct("ts", "tick_id")
    return (
        ticks.groupBy("symbol", _frame("ts", tf).alias("_w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count("*").alias("volume"),
            F.max_by("spread", order).alias("spread"),
        )
        .select(
            "symbol",
            F.lit(tf).alias("tf"),
            F.col("_w.start").alias("bar_ts"),
            "open", "high", "low", "close", "volume", "spread",
        )
    )


def resample(bars: DataFrame, tf: str, source: str) -> DataFrame:
    """Bars of the timeframe `source` joined into bars of `tf`; other timeframes are passed over."""
    if WIDTHS[tf] % WIDTHS[source]:
        raise ValueError(f"{tf} is no multiple of {source}")
    return (
        bars.filter(F.col("tf") == source)
        .groupBy("symbol", _frame("bar_ts", tf).alias("_w"))
        .agg(
            F.min_by("open", "bar_ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.max_by("spread", "bar_ts").alias("spread"),
        )
        .select(
            "symbol",
            F.lit(tf).alias("tf"),
            F.col("_w.start").alias("bar_ts"),
            "open", "high", "low", "close", "volume", "spread",
        )
    )
