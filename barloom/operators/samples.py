"""Training samples, forward labels, the quantile baseline, and feature audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.sqlmath import ratio
from barloom.operators.joins import diff_within
from barloom.operators.quality import dedupe
from barloom.operators.rolling import quantiles_before
from barloom.operators.tiles import NO, SERIES, number_bars, tiled
from barloom.session import store


def windows(bars: DataFrame, cols: Sequence[str], length: int, horizon: int) -> DataFrame:
    """Samples `x` (the last `length` rows of `cols`) and `y`, the close `horizon` rows on."""

    def sample(df: DataFrame, w) -> DataFrame:
        return df.withColumns(
            {
                "x": F.collect_list(F.struct(*cols)).over(w.rowsBetween(-length + 1, 0)),
                "y": F.lead("close", horizon).over(w),
            }
        )

    made = tiled(number_bars(bars), sample, before=length - 1, after=horizon)
    full = (F.size("x") == length) & F.col("y").isNotNull()
    return made.filter(full).select(*SERIES, "bar_ts", "x", "y")


def forward_labels(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Shape and direction of the bar `horizon` rows on, and the return up to it."""

    def label(df: DataFrame, w) -> DataFrame:
        ahead = {c: F.lead(c, horizon).over(w) for c in ("open", "high", "low", "close")}
        return df.withColumns({f"_{c}": v for c, v in ahead.items()})

    rng = F.col("_high") - F.col("_low")

    def part(x: Column) -> Column:
        return F.when(rng == 0, 0.0).otherwise(ratio(x, rng))

    made = tiled(number_bars(bars), label, after=horizon).filter(F.col("_close").isNotNull())
    return made.select(
        *SERIES,
        "bar_ts",
        part(F.abs(F.col("_close") - F.col("_open"))).alias("next_body"),
        part(F.col("_high") - F.greatest("_open", "_close")).alias("next_upper"),
        part(F.least("_open", "_close") - F.col("_low")).alias("next_lower"),
        (ratio("_close", "close") - 1).alias("next_return"),
        (F.col("_close") > F.col("close")).alias("next_up"),
    )


def quantile_baseline(bars: DataFrame, win: int = 100, min_n: int = 20) -> DataFrame:
    """Forecast each close from the returns of the `win` bars before it.

    Gives price quantiles, the share of rising bars as `p_bull`, and the confidence
    in the likelier direction.
    """

    def returns(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_pc", F.lag("close").over(w)).withColumn(
            "_r", ratio("close", "_pc") - 1
        )

    def forecast(df: DataFrame, w) -> DataFrame:
        df = returns(df, w)
        frame = w.rowsBetween(-win, -1)
        df = df.withColumn("p_bull", F.avg((F.col("_r") > 0).cast("double")).over(frame))
        return quantiles_before(df, w, [*SERIES, "_tile"], NO, "_r", win, {f"_q{q}": q / 100 for q in (10, 50, 90)}, "_n")

    made = tiled(number_bars(bars), forecast, before=win + 1).filter(F.col("_n") >= min_n)
    price = lambda q: F.col("_pc") * (1 + F.col(f"_q{q}"))
    return made.select(
        *SERIES,
        "bar_ts",
        price(10).alias("q10"),
        price(50).alias("q50"),
        price(90).alias("q90"),
        "p_bull",
        F.greatest("p_bull", 1 - F.col("p_bull")).alias("confidence"),
    )


def causality_diff(
    feature: Callable[[DataFrame], DataFrame],
    bars: DataFrame,
    cut: Column,
    cols: Sequence[str],
    tol: float = 1e-9,
) -> DataFrame:
    """Rows before `cut` whose features change once later bars are known; none should."""
    keys = [*SERIES, "bar_ts"]
    early = F.col("bar_ts") < cut
    whole = feature(bars).filter(early).select(*keys, *cols)
    prefix = feature(bars.filter(early)).select(*keys, *cols)
    return diff_within(whole, prefix, keys, cols, tol)


def causality_audit(
    feature: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: Column, cols: Sequence[str]
) -> DataFrame:
    """Per series: rows that both computations hold, and rows whose features differ."""
    keys = [*SERIES, "bar_ts"]
    early = F.col("bar_ts") < cut
    whole = feature(bars).filter(early).select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    prefix = feature(bars.filter(early)).select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    changed = diff_within(whole, prefix, keys, cols, 1e-9).groupBy(*SERIES).agg(F.count("*").alias("changed"))
    both = whole.select(*keys).join(prefix.select(*keys), keys)
    compared = both.groupBy(*SERIES).agg(F.count("*").alias("compared"))
    none = F.lit(0).cast("bigint")
    return compared.join(changed, list(SERIES), "full_outer").select(
        *SERIES, F.coalesce("compared", none).alias("compared"), F.coalesce("changed", none).alias("changed")
    )


def stationarity(df: DataFrame, cols: Sequence[str], blocks: int) -> DataFrame:
    """Mean and deviation of each column in equal stretches of each series.

    The stretch of a row follows from its position and the row count alone. The counts,
    one per series, are stored so that the rows need no shuffle by series.
    """
    numbered = number_bars(df)
    counts = store(numbered.groupBy(*SERIES).agg(F.count("*").alias("_n")), "series-counts")
    sized = numbered.join(counts, list(SERIES))
    small, extra = F.floor(F.col("_n") / blocks), F.col("_n") % blocks
    edge = extra * (small + 1)  # the first `extra` stretches hold one row more
    stretch = F.when(F.col(NO) < edge, F.floor(F.col(NO) / (small + 1))).otherwise(
        extra + F.floor((F.col(NO) - edge) / F.greatest(small, F.lit(1)))
    )
    stats = [
        s for c in cols for s in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))
    ]
    return sized.groupBy(*SERIES, (stretch + 1).cast("int").alias("block")).agg(
        F.count("*").alias("n"), *stats
    )


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Newest row of each key."""
    return dedupe(df, keys, [F.col(c).desc() for c in order])
