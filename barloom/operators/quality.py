"""Cleaning and health checks of ticks and bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.clock import WIDTHS, market_open, plus_seconds
from barloom.operators.rolling import quantiles_before
from barloom.operators.tiles import NO, SERIES, Scan, number_bars, number_ticks, running, tiled


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in `order`.

    The rank filter becomes a group limit ahead of the shuffle, so a key with very
    many copies sends one row per input split.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def sort_utc(df: DataFrame, ts: str, src_tz: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Convert local clock times to UTC and range-partition in (keys, time) order."""
    utc = df.withColumn(ts, F.convert_timezone(F.lit(src_tz), F.lit("UTC"), F.col(ts)))
    return utc.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts)


def open_slots(after: Column, before: Column, width: int) -> Column:
    """Count of slots in (after, before) in which the market is open, day by day."""
    step = F.make_dt_interval(secs=F.lit(width))
    first, last = after + step, before - step
    one_day = F.expr("interval 1 day")
    days = F.sequence(F.date_trunc("day", first).cast("timestamp_ntz"), last, one_day)

    def of_day(day: Column) -> Column:
        slots = F.sequence(day, day + one_day - step, step)
        return F.size(F.filter(slots, lambda s: s.between(first, last) & market_open(s)))

    count = F.aggregate(days, F.lit(0).cast("bigint"), lambda acc, day: acc + of_day(day))
    return F.when(before > first, count).otherwise(F.lit(0).cast("bigint"))


def find_gaps(bars: DataFrame, tf: str) -> DataFrame:
    """Holes between consecutive bars of timeframe `tf` that cover at least one open slot."""

    def pairs(df: DataFrame, w) -> DataFrame:
        return df.withColumn("gap_end", F.lead("bar_ts").over(w))

    seen = tiled(number_bars(bars.filter(F.col("tf") == tf)), pairs, after=1)
    holes = seen.filter(F.col("gap_end") > plus_seconds("bar_ts", WIDTHS[tf]))
    return holes.select(
        "symbol",
        F.col("bar_ts").alias("gap_start"),
        "gap_end",
        open_slots(F.col("bar_ts"), F.col("gap_end"), WIDTHS[tf]).alias("missing"),
    ).filter("missing > 0")


def missing_slots(bars: DataFrame, tf: str) -> DataFrame:
    """Open slots between the first and last bar of a symbol in `tf` that hold no bar."""
    bars = bars.filter(F.col("tf") == tf)
    step = F.make_dt_interval(secs=F.lit(WIDTHS[tf]))
    span = bars.groupBy("symbol").agg(F.min("bar_ts").alias("lo"), F.max("bar_ts").alias("hi"))
    days = span.withColumn(
        "day",
        F.explode(F.sequence(F.date_trunc("day", "lo").cast("timestamp_ntz"), F.col("hi"), F.expr("interval 1 day"))),
    ).repartition("symbol", "day")
    last = F.col("day") + F.expr("interval 1 day") - step
    grid = days.select("symbol", "lo", "hi", F.explode(F.sequence(F.col("day"), last, step)).alias("bar_ts"))
    grid = grid.filter(F.col("bar_ts").between(F.col("lo"), F.col("hi")) & market_open("bar_ts"))
    return grid.select("symbol", "bar_ts").join(
        bars.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_anti"
    )


def _unsound(c: str) -> Column:
    """Unknown, not a number, or infinite."""
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def chk_key(*cols: str) -> Column:
    """A part of the row's key or its time is unknown."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return bad


def chk_price(*cols: str) -> Column:
    """Any of the prices is unknown, not a finite number, zero or negative."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | _unsound(c) | (F.col(c) <= 0)
    return bad


def chk_ohlc() -> Column:
    """Open or close lies outside [low, high]."""
    inside = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return ~F.coalesce(inside, F.lit(False))


def chk_spread(spread: str, median: str, k: float) -> Column:
    """Spread is not a positive finite number, or above `k` times the recent median."""
    wide = F.coalesce(F.col(spread) > k * F.col(median), F.lit(False))
    return _unsound(spread) | (F.col(spread) <= 0) | wide


def chk_order(ts: str, newest: str) -> Column:
    """A row that arrived earlier is newer."""
    return F.coalesce(F.col(ts) < F.col(newest), F.lit(False))


def spread_median(ticks: DataFrame, n: int) -> DataFrame:
    """Add `spread_median`: exact median of the previous `n` ticks of the symbol.

    Unknown spreads and those that are not a number do not count. Ticks without symbol or
    time have none.
    """
    known = F.when(~F.isnan("spread"), F.col("spread"))

    def recent(df: DataFrame, w) -> DataFrame:
        df = df.withColumn("_known", known)
        return quantiles_before(df, w, ["symbol", "_tile"], NO, "_known", n, {"spread_median": 0.5}, "_recent")

    return tiled(number_ticks(ticks), recent, before=n, keys=["symbol"]).drop("_known", "_recent")


def newest_before(
    ticks: DataFrame,
    arrival: Sequence[str],
    chunk: Column,
    ts: str = "ts",
    base: DataFrame | None = None,
) -> DataFrame:
    """Add `newest`: highest timestamp among the rows of the symbol that arrived earlier."""
    scan = Scan("newest", "max", F.col(ts))
    return running(ticks, ["symbol"], arrival, chunk, [scan], inclusive=False, base=base)


def validate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add `violations`: the names of all checks that a row fails."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return df.withColumn("violations", found)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows."""
    clean = F.size("violations") == 0
    return validated.filter(clean).drop("violations"), validated.filter(~clean)


def tick_checks(k: float) -> dict[str, Column]:
    return {
        "key": chk_key("symbol", "ts"),
        "price": chk_price("price"),
        "spread": chk_spread("spread", "spread_median", k),
        "order": chk_order("ts", "newest"),
    }


def bar_checks() -> dict[str, Column]:
    return {
        "key": chk_key(*SERIES, "bar_ts"),
        "price": chk_price("open", "high", "low", "close"),
        "spread": _unsound("spread") | (F.col("spread") <= 0),
        "ohlc": chk_ohlc(),
    }


def checked_ticks(ticks: DataFrame, arrival: Sequence[str], chunk: Column, n: int, k: float) -> DataFrame:
    """All tick checks in one pass over rows that carry their recent context."""
    context = newest_before(spread_median(ticks, n), arrival, chunk, base=ticks)
    return validate(context, tick_checks(k))


def health_report(
    validated: DataFrame, checks: Sequence[str], by: Sequence[str] = SERIES
) -> DataFrame:
    """Rows and violations per check for each key, with subtotals and the grand total."""
    counts = [
        F.count_if(F.array_contains("violations", name)).alias(f"bad_{name}") for name in checks
    ]
    return validated.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n"),
        F.count_if(F.size("violations") > 0).alias("bad"),
        *counts,
    )
