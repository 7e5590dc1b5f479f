"""From forecasts to order proposals, and the search for order parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import features as ft
from barloom.operators.labels import expectancy_filter, path_ahead, valid_order
from barloom.operators.samples import quantile_baseline
from barloom.operators.tiles import SERIES

# Fixed value: confidence above which a forecast triggers an order.
TRIGGER = 0.70


def trigger(forecasts: DataFrame, threshold: float = TRIGGER) -> DataFrame:
    return forecasts.filter(F.col("confidence") > threshold)


def spread_ok(df: DataFrame, max_spread: float) -> DataFrame:
    return df.filter(F.col("spread") <= max_spread)


def propose(
    forecasts: DataFrame,
    context: DataFrame,
    discount: float = 0.25,
    sl: float = 1.0,
    tp: float = 1.5,
    expiry_bars: int = 6,
) -> DataFrame:
    """Limit orders from forecasts; distances are multiples of the ATR in `context`.

    `context` holds one row per bar (close, atr, spread) and meets the forecasts on
    the bar key. A forecast without context gives an order with NULL prices, which
    `valid_order` refuses.
    """
    known = context.select(*SERIES, "bar_ts", "close", "atr", "spread")
    rows = forecasts.join(known, [*SERIES, "bar_ts"], "left")
    up = F.col("p_bull") >= 0.5
    way = F.when(up, 1.0).otherwise(-1.0)
    entry = F.round(F.col("close") - way * discount * F.col("atr"), 5)
    rows = rows.withColumns(
        {"side": F.when(up, "BUY_LIMIT").otherwise("SELL_LIMIT"), "entry": entry}
    )
    return rows.select(
        *SERIES,
        "bar_ts",
        "side",
        "entry",
        F.round(F.col("entry") - way * sl * F.col("atr"), 5).alias("sl"),
        F.round(F.col("entry") + way * tp * F.col("atr"), 5).alias("tp"),
        F.lit(expiry_bars).alias("expiry_bars"),
        F.col("confidence").alias("p_win"),
        F.col("spread").alias("friction"),
    )


def policy_grid(
    bars: DataFrame,
    discounts: Sequence[float],
    stops: Sequence[float],
    targets: Sequence[float],
    expiry_bars: int,
    horizon: int,
) -> DataFrame:
    """Mean P/L in ATR units of every buy-limit setting, per volatility regime.

    Bars without a defined regime form a group of their own, with a NULL regime.

    Features and the forward path of a bar come from one tiling. A path never leaves its row: every
    setting is played on it where it is (see `played`), and a task hands on one row of sums per regime
    and setting.
    """
    reach = expiry_bars + horizon
    made = ft.compute(bars, ft.atr(), ft.vol_expansion(), path_ahead(reach)).select(
        "close",
        "atr",
        F.when(F.col("vol_expansion") > 1, "expanding").when(F.col("vol_expansion").isNotNull(), "calm").alias("regime"),
        *[F.col("_path").getField(c).cast("array<double>").alias(f"_{c}") for c in ("high", "low", "close")],
    )
    levels = [tuple(sorted({float(v) for v in values})) for values in (discounts, stops, targets)]
    return played(made, *levels, expiry_bars, horizon).groupBy("regime", "discount", "stop", "target").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("filled"), F.sum("n")).alias("fill_rate"),
        F.try_divide(F.sum("gain"), F.sum("gained")).alias("ev"),
    )


def played(
    paths: DataFrame,
    discounts: Sequence[float],
    stops: Sequence[float],
    targets: Sequence[float],
    expiry_bars: int,
    horizon: int,
) -> DataFrame:
    """Sums over the rows of a task: regime, discount, stop, target, n, filled, gain, gained.

    `paths` has close, atr, regime and the arrays _high, _low and _close of the bars ahead. Running
    extrema are monotone, so the first bar that reaches a level is found by binary search: once per
    discount for the fill, and once per discount and stop, or target, for what follows it. Settings only
    combine those positions. n counts rows with a P/L, filled the filled ones among them; gain sums the
    P/L in ATR units over the `gained` rows with an ATR other than zero. Unknown prices reach nothing.
    """
    reach = expiry_bars + horizon
    schema = T.StructType(
        [
            T.StructField("regime", T.StringType()),
            *[T.StructField(c, T.DoubleType()) for c in ("discount", "stop", "target")],
            *[T.StructField(c, T.LongType()) for c in ("n", "filled")],
            T.StructField("gain", T.DoubleType()),
            T.StructField("gained", T.LongType()),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def numbers(column):
            """Values, and which of them are NULL."""
            return column.to_numpy(zero_copy_only=False).astype(float), column.is_null().to_numpy(zero_copy_only=False)

        def ahead(column, missing):
            """Bars down, rows across; `missing` where a path has no such bar or no price. NaN is above all."""
            values, gone = numbers(column.values)
            starts = np.asarray(column.offsets)[:-1]
            at = np.arange(reach)[:, None] + starts
            there = np.arange(reach)[:, None] < np.asarray(column.value_lengths().fill_null(0))
            if not len(values):
                return np.full(at.shape, missing)
            values = np.where(gone, missing, np.where(np.isnan(values), np.inf, values))
            return np.where(there, values[np.minimum(at, len(values) - 1)], missing)

        def level(values, unknown):
            """A NULL level is never reached, NaN is above every number."""
            return np.where(np.isnan(values), np.inf, values), unknown

        def first(extrema, reached):
            """Position of the first bar at which `reached` holds of a running extremum, else `reach`."""
            low = np.zeros(extrema.shape[1], int)
            high = np.full(extrema.shape[1], extrema.shape[0])
            rows = np.arange(extrema.shape[1])
            for _ in range(extrema.shape[0].bit_length()):
                middle = np.minimum((low + high) // 2, extrema.shape[0] - 1)
                found = reached(extrema[middle, rows])
                going = low < high
                high, low = np.where(going & found, middle, high), np.where(going & ~found, middle + 1, low)
            return high

        sums: dict[tuple, list] = {}
        for batch in batches:
            close, no_close = numbers(batch.column("close"))
            atr, no_atr = numbers(batch.column("atr"))
            size = np.asarray(batch.column("_low").value_lengths().fill_null(-1))
            lows, highs = ahead(batch.column("_low"), np.inf), ahead(batch.column("_high"), -np.inf)
            ends, rows = batch.column("_close"), np.arange(len(close))
            end_values, end_gone = numbers(ends.values)
            starts = np.asarray(ends.offsets)[:-1]
            kinds = np.array([{"expanding": 0, "calm": 1}.get(r, 2) for r in batch.column("regime").to_pylist()], int)
            unknown, bar = no_close | no_atr, np.arange(reach)[:, None]
            falls = np.minimum.accumulate(lows[:expiry_bars], axis=0) if expiry_bars else lows[:0]
            for d in discounts:
                entry = close - d * atr
                at, never = level(entry, unknown)
                fill = np.where(never, expiry_bars, first(falls, lambda v: v <= at)) if expiry_bars else np.zeros(len(close), int)  # noqa: B023
                filled = (fill < np.minimum(expiry_bars, size)) & ~never
                expired = ~filled & (size >= expiry_bars)
                # The bars that count for the barriers: `horizon` of them after the fill.
                rest = (bar > fill) & (bar <= fill + horizon)
                under = np.minimum.accumulate(np.where(rest, lows, np.inf), axis=0)
                over = np.maximum.accumulate(np.where(rest, highs, -np.inf), axis=0)
                whole = size > fill + horizon
                last = np.minimum(starts + fill + horizon, max(len(end_values) - 1, 0))
                ended = filled & whole & (horizon > 0)
                final = np.where(ended, end_values[last], np.nan) if len(end_values) else np.full(len(close), np.nan)
                ended = ended & ~end_gone[last] if len(end_values) else ended
                down, up = {}, {}
                for s in stops:
                    stop, _ = level(entry - s * atr, unknown)
                    down[s] = first(under, lambda v: (v <= stop) & (v < np.inf)), entry - s * atr  # noqa: B023
                for t in targets:
                    target, _ = level(entry + t * atr, unknown)
                    up[t] = first(over, lambda v: (v >= target) & (v > -np.inf)), entry + t * atr  # noqa: B023
                for s, (stop_at, stop) in down.items():
                    for t, (target_at, target) in up.items():
                        lost = filled & (stop_at < reach) & (stop_at <= target_at)
                        won = filled & ~lost & (target_at < reach)
                        counted = lost | won | expired | (ended & ~lost & ~won)
                        price = np.where(lost, stop, np.where(won, target, final))
                        pnl = np.where(expired, 0.0, price - entry)
                        use = counted & ~no_atr & (atr != 0)
                        gains = np.divide(pnl, atr, out=np.zeros(len(close)), where=use)
                        for kind in np.unique(kinds).tolist():
                            mine = kinds == kind
                            held = sums.setdefault((kind, d, s, t), [0, 0, 0.0, 0])
                            held[0] += int((counted & mine).sum())
                            held[1] += int((counted & filled & mine).sum())
                            held[2] += float(gains[use & mine].sum())
                            held[3] += int((use & mine).sum())
        names = ("expanding", "calm", None)
        found = [(names[kind], *setting, *held) for (kind, *setting), held in sums.items()]
        columns = list(zip(*found, strict=True)) or [()] * len(schema)
        arrow = [pa.string(), *[pa.float64()] * 3, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, arrow, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return paths.mapInArrow(run, schema)


def best_policy(grid: DataFrame) -> DataFrame:
    """Setting with the highest mean P/L of each regime; ties go to the smaller setting."""
    point = F.struct("ev", -F.col("discount"), -F.col("stop"), -F.col("target"))
    chosen = F.struct("discount", "stop", "target", "n", "fill_rate", "ev")
    return grid.groupBy("regime").agg(F.max_by(chosen, point).alias("_b")).select("regime", "_b.*")


def propose_from_bars(bars: DataFrame) -> DataFrame:
    """Bars to filtered proposals: features, forecast, order, validity and expectancy."""
    context = ft.compute(bars, ft.atr())
    orders = propose(quantile_baseline(bars), context)
    return expectancy_filter(orders.filter(valid_order()))
