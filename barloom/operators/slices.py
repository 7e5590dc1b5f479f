"""Time slices of a long extraction: plan, coverage, assembly."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import dedupe


def plan_slices(symbols: DataFrame, start: datetime, end: datetime, width: str) -> DataFrame:
    """One row per symbol and window [lo, hi) of `width` (such as '1 year')."""
    step = F.expr(f"interval {width}")
    first, stop = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (
        symbols.select("symbol", F.explode(F.sequence(first, stop, step)).alias("lo"))
        .filter(F.col("lo") < stop)
        .select("symbol", "lo", F.least(F.col("lo") + step, stop).alias("hi"))
    )


def slice_coverage(slices: DataFrame, bars: DataFrame, cap: int, tf: str) -> DataFrame:
    """Rows of timeframe `tf` landed per slice; flags empty slices and those at the row cap.

    Bars meet slices by (symbol, day), then by the exact range; a day of one
    symbol holds at most its bar slots.
    """
    one_day = F.expr("interval 1 day")
    bars = bars.filter(F.col("tf") == tf)
    days = slices.withColumn(
        "_day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), one_day))
    )
    landed = (
        days.join(
            bars.select("symbol", "bar_ts", F.to_date("bar_ts").alias("_day")), ["symbol", "_day"]
        )
        .filter((F.col("bar_ts") >= F.col("lo")) & (F.col("bar_ts") < F.col("hi")))
        .groupBy("symbol", "lo")
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return slices.join(landed, ["symbol", "lo"], "left").select(
        "symbol", "lo", "hi", n.alias("n"), (n == 0).alias("is_empty"), (n >= cap).alias("at_cap")
    )


def union_slices(*slices: DataFrame) -> DataFrame:
    """One series from overlapping slices; the later slice wins at the edges."""
    numbered = [df.withColumn("_slice", F.lit(i)) for i, df in enumerate(slices)]
    merged = reduce(DataFrame.unionByName, numbered)
    return dedupe(merged, ["symbol", "tf", "bar_ts"], [F.col("_slice").desc()]).drop("_slice")
