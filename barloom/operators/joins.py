"""Joins between series: aligned timeframes, forecasts and outcomes, positions, tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.clock import WIDTHS, plus_seconds
from barloom.operators.quality import dedupe
from barloom.operators.tiles import asof_all
from barloom.session import store


def align(
    fast: DataFrame, slow: DataFrame, fast_tf: str, slow_tfs: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Attach to each fast bar the last bar of each slow timeframe closed by then.

    `slow` may hold several timeframes; `slow_tfs` names the columns taken from each, which
    get the timeframe as prefix, with its `bar_ts`. All of them share one as-of pass.
    """
    decided = fast.filter(F.col("tf") == fast_tf).withColumn(
        "_decided", plus_seconds("bar_ts", WIDTHS[fast_tf])
    )
    rights = []
    for tf, cols in slow_tfs.items():
        names = [f"{tf.lower()}_{c}" for c in ("bar_ts", *cols)]
        closed = slow.filter(F.col("tf") == tf).select(
            "symbol",
            plus_seconds("bar_ts", WIDTHS[tf]).alias("_closed"),
            *[F.col(c).alias(n) for c, n in zip(("bar_ts", *cols), names)],
        )
        rights.append((closed, "_closed", names))
    grain = 16 * max(WIDTHS[tf] for tf in slow_tfs)
    return asof_all(decided, rights, ["symbol"], "_decided", grain).drop("_decided")


def forecast_vs_actual(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecast rows with the realised bar, if there is one, and whether it hit the corridor."""
    actual = bars.select("symbol", "tf", "bar_ts", "open", "high", "low", "close")
    return forecasts.join(actual, ["symbol", "tf", "bar_ts"], "left").withColumn(
        "hit", F.col("close").between(F.col("q10"), F.col("q90"))
    )


def quotes(ticks: DataFrame) -> DataFrame:
    """Last tick of each symbol."""
    last = dedupe(ticks, ["symbol"], [F.col("ts").desc(), F.col("tick_id").desc()])
    return last.select("symbol", F.col("price").alias("quote"), F.col("spread").alias("quote_spread"))


def floating_pnl(positions: DataFrame, last: DataFrame, contract: float = 1.0) -> DataFrame:
    """Positions valued at the last quote; half the spread is paid on closing.

    The quotes, one per symbol, are stored first: with their size known the positions
    need no shuffle by symbol unless there are very many symbols.
    """
    way = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    exit_price = F.col("quote") - way * F.col("quote_spread") / 2
    gain = way * (exit_price - F.col("entry")) * F.col("volume") * contract
    known = store(last, "quotes")
    return positions.join(known, "symbol", "left").withColumn("floating_pnl", gain)


def equity(accounts: DataFrame, valued: DataFrame) -> DataFrame:
    """Balance plus floating P/L of each account.

    A position without a quote cannot be valued: `unvalued` counts them, and the floating P/L
    and equity of an account that has any are unknown (NULL).
    """
    open_pnl = valued.groupBy("account_id").agg(
        F.sum("floating_pnl").alias("floating_pnl"),
        F.count("*").alias("positions"),
        F.count_if(F.col("floating_pnl").isNull()).alias("unvalued"),
    )
    none = F.lit(0).cast("bigint")
    unvalued = F.coalesce("unvalued", none)
    floating = F.when(unvalued == 0, F.coalesce("floating_pnl", F.lit(0.0)))
    return accounts.join(open_pnl, "account_id", "left").select(
        "account_id",
        "balance",
        floating.alias("floating_pnl"),
        F.coalesce("positions", none).alias("positions"),
        unvalued.alias("unvalued"),
        (F.col("balance") + floating).alias("equity"),
    )


def diff_within(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-5
) -> DataFrame:
    """Rows that only one table has, or whose values differ by more than `tol`."""
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    off = F.lit(False)
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
    state = (
        F.when(F.col("_a").isNull(), "only_b")
        .when(F.col("_b").isNull(), "only_a")
        .when(off, "differs")
    )
    joined = left.join(right, list(keys), "full_outer").withColumn("state", state)
    return joined.filter(F.col("state").isNotNull()).drop("_a", "_b")
