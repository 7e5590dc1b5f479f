"""Aggregate reports: features, trades, forecasts, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.clock import col, slot
from barloom.functions.sqlmath import norm_cdf, norm_ppf, ratio


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order, type and normalisation constants of each feature, one row per feature."""
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(i).alias("idx"),
            F.lit(types[c]).alias("dtype"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.count(c).alias("n"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(F.array(*aggs).alias("_s")).select(F.inline("_s"))


def trade_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, win rate, profit and profit factor."""
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0))
    loss = F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl").alias("profit"),
        ratio(gain, loss).alias("profit_factor"),
    )


def path_summary(
    df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, pnl: str = "pnl"
) -> DataFrame:
    """Summary of each (key, chunk) stretch of a P/L sequence, enough to chain stretches.

    `total` is its sum, `top` the highest and `fall` the deepest point relative to the
    start, `drop` the largest fall from a peak inside it (the start counts as a peak).
    """
    src = df.withColumn("_chunk", chunk)
    w = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    eq = src.withColumn("_eq", F.sum(pnl).over(w))
    peak = eq.withColumn("_peak", F.greatest(F.max("_eq").over(w), F.lit(0.0)))
    return peak.groupBy(*by, "_chunk").agg(
        F.sum(pnl).alias("total"),
        F.greatest(F.max("_eq"), F.lit(0.0)).alias("top"),
        F.least(F.min("_eq"), F.lit(0.0)).alias("fall"),
        F.max(F.col("_peak") - F.col("_eq")).alias("drop"),
    )


def chain(stretches: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Summary of the stretches of each key laid end to end in `order`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = stretches.withColumn("_start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    peak = start.withColumn(
        "_peak", F.greatest(F.max(F.col("_start") + F.col("top")).over(before), F.lit(0.0))
    )
    low = F.col("_start") + F.col("fall")
    return peak.groupBy(*by).agg(
        F.sum("total").alias("total"),
        F.max(F.col("_start") + F.col("top")).alias("top"),
        F.min(low).alias("fall"),
        F.max(F.greatest("drop", F.col("_peak") - low)).alias("drop"),
    )


def max_drawdown(trades: DataFrame, by: Sequence[str], grain: int = 60) -> DataFrame:
    """Largest fall of the equity below its running peak, in closing order.

    Rows are reduced to one summary per `grain` seconds of each key; only the
    summaries, bounded by the calendar, are chained in one window per key.
    """
    chunk = slot("close_ts", grain)
    chained = chain(path_summary(trades, by, ["close_ts", "trade_id"], chunk), by, "_chunk")
    return chained.select(*by, F.col("drop").alias("max_drawdown"))


def moments(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, Sharpe ratio, skewness and plain kurtosis of the P/L."""
    return trades.groupBy(*by).agg(
        F.count("pnl").alias("n"),
        F.avg("pnl").alias("mean"),
        F.stddev_samp("pnl").alias("std"),
        ratio(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"),
        F.skewness("pnl").alias("skew"),
        (F.kurtosis("pnl") + 3).alias("kurt"),
    )


# Euler's constant and e, in the expected maximum of N Sharpe ratios.
EULER, E = 0.5772156649015329, 2.718281828459045


def deflated_sharpe(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Probability that the Sharpe ratio beats the best of N skill-less trials.

    Every group is one trial; their number and the variance of their ratios are
    aggregated, so only one row per trial is ever joined.
    """
    trial = moments(trades, by)
    # Ungrouped aggregates: single values, used as scalar subqueries.
    trials = trial.agg(F.count("sharpe")).scalar()
    spread = trial.agg(F.var_samp("sharpe")).scalar()
    with_field = trial.select("*", trials.alias("trials"), spread.alias("_spread"))
    best = F.sqrt("_spread") * (
        (1 - EULER) * norm_ppf(1 - 1 / F.col("trials"))
        + EULER * norm_ppf(1 - 1 / (F.col("trials") * E))
    )
    sr = F.col("sharpe")
    error = F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    z = ratio((sr - F.col("expected_best")) * F.sqrt(F.col("n") - 1), error)
    return (
        with_field.withColumn("expected_best", best).withColumn("dsr", norm_cdf(z)).drop("_spread")
    )


def proof_report(trades: DataFrame, by: Sequence[str], grain: int = 60) -> DataFrame:
    """Trade statistics, drawdown and deflated Sharpe ratio per strategy."""
    return (
        trade_stats(trades, by)
        .join(max_drawdown(trades, by, grain), list(by))
        .join(deflated_sharpe(trades, by).select(*by, "sharpe", "expected_best", "dsr"), list(by))
    )


def pinball(
    scored: DataFrame, by: Sequence[str], actual: str, quantiles: dict[str, float]
) -> DataFrame:
    """Mean quantile loss of each forecast column and coverage of the outer interval."""
    y = F.col(actual)
    losses = [
        F.avg(F.greatest(tau * (y - F.col(c)), (tau - 1) * (y - F.col(c)))).alias(f"loss_{c}")
        for c, tau in quantiles.items()
    ]
    lo, hi = min(quantiles, key=quantiles.get), max(quantiles, key=quantiles.get)
    inside = y.between(F.col(lo), F.col(hi)).cast("double")
    return scored.groupBy(*by).agg(F.count(y).alias("n"), *losses, F.avg(inside).alias("coverage"))


def direction_metrics(df: DataFrame, by: Sequence[str], p: str, up: str) -> DataFrame:
    """Accuracy, log loss and Brier score of a probability that `up` is true."""
    y = F.col(up).cast("double")
    q = F.greatest(F.least(col(p), F.lit(1 - 1e-9)), F.lit(1e-9))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(((col(p) > 0.5) == F.col(up)).cast("double")).alias("accuracy"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((q - y) * (q - y)).alias("brier"),
    )


def label_mix(labels: DataFrame, label: str, values: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Rows per key and label value, one column per value."""
    names = {v: f"label_{'m' if v < 0 else ''}{abs(v)}" for v in values}
    counted = labels.groupBy(*by).pivot(label, list(values)).count()
    return counted.select(
        *by, *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("bigint")).alias(names[v]) for v in values]
    )
