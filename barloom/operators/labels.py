"""Barrier labels, limit-order fills and outcomes, expectancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.operators import passage, tiles
from barloom.operators.features import Feature, Stage, apply_stages
from barloom.operators.tiles import NO, SERIES, asof, number_bars, tile, tile_window
from barloom.session import store

PATH = ("bar_ts", "high", "low", "close")
WEEK = 7 * 86400


def path_ahead(horizon: int) -> Feature:
    """The next `horizon` bars of each bar, as the array column `_path`."""

    def path(w: WindowSpec) -> Column:
        return F.collect_list(F.struct(*PATH)).over(w.rowsBetween(1, horizon))

    return Feature(("_path",), 0, (Stage({"_path": path}),), after=horizon)


def triple_barrier(
    bars: DataFrame, tp: Column, sl: Column, horizon: int, features: Sequence[Feature] = ()
) -> DataFrame:
    """Label each bar by what its close meets first in the next `horizon` bars.

    1 for the profit barrier `tp` above, -1 for the loss barrier `sl` below or both
    in one bar, 0 for neither; NULL while fewer bars are known and none was met. The
    distances may use `features`, which are computed on the same tiles. Horizons up to
    `passage.HALO` bars are answered on these tiles as well; longer ones go on from there.
    """
    near = min(horizon, passage.HALO)
    before = max([f.before for f in features], default=0)
    made = tile(number_bars(bars), before, near, tiles.TILE)
    made = apply_stages(made, tile_window(), features) if features else made
    names = [n for f in features for n in f.outputs]
    made = made.withColumns({n: F.when(F.col(NO).isNotNull(), F.col(n)) for n in names})
    # Rows without a position ask for nothing; they stand in small groups of their own.
    own = (F.col("_tile") == F.floor(F.col(NO) / tiles.TILE)) | (F.col("_tile") < 0)
    alone = F.when(F.col("_tile") < 0, F.xxhash64("bar_ts", "close")).alias("_part")
    ahead = passage.question(F.col(NO) + 1, F.col(NO) + horizon, F.col("close") + tp, F.col("close") - sl)
    line = made.select(
        *SERIES, "_tile", alone, F.when(F.col(NO) >= F.col("_tile") * tiles.TILE, passage.bar_struct()).alias("_bar"),
        F.when(own, ahead).alias("_q"), "bar_ts",
    )
    met = passage.answered(line, [*SERIES, "_tile", "_part"])
    if horizon > near:
        numbered = number_bars(bars).select(*SERIES, NO, passage.bar_struct().alias("_bar"))
        met = passage.further(store(met, "barriers"), numbered, horizon, SERIES, [*SERIES, "_q", "bar_ts"])
    up, down = F.col("_q.up"), F.col("_q.down")
    label = (
        F.when(F.col("_hit.low") <= down, -1)
        .when(F.col("_hit").isNotNull(), 1)
        .when(F.col("_last").isNotNull(), 0)
    )
    return met.select(
        *SERIES, "bar_ts", up.alias("tp_level"), down.alias("sl_level"), label.alias("label"), F.col("_hit.bar_ts").alias("touch_ts")
    )


def on_bars(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Add `_at_no`, the position of the last bar at or before an order's time; NULL without one.

    The time is the order's `bar_ts`, on the grid of the bars or off it.
    """
    marks = bars.select(*SERIES, F.col("bar_ts").alias("_on"), F.col(NO).alias("_at_no"))
    return asof(orders, marks, SERIES, "bar_ts", "_on", ["_at_no"], WEEK)


def _buy() -> Column:
    return F.col("side") == "BUY_LIMIT"


def _with_pnl(df: DataFrame, last: Column) -> DataFrame:
    """Add the P/L of an outcome; `last` is the close at which an undecided trade ends."""
    price = (
        F.when(F.col("outcome") == "SL", F.col("sl"))
        .when(F.col("outcome") == "TP", F.col("tp"))
        .when(F.col("outcome") == "TIMEOUT", last)
    )
    way = F.when(_buy(), 1.0).otherwise(-1.0)
    pnl = F.when(F.col("outcome") == "EXPIRED", 0.0).otherwise(way * (price - F.col("entry")))
    return df.withColumn("pnl", pnl)


def _public(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def _within(orders: DataFrame, max_expiry: int | None) -> tuple[DataFrame, int]:
    """The orders and the longest expiry; an order beyond a stated one is an error."""
    if max_expiry is None:
        return orders, orders.agg(F.max("expiry_bars")).first()[0] or 0
    beyond = F.raise_error(F.lit(f"an order's expiry_bars is above {max_expiry}")).cast("int")
    kept = F.when(F.col("expiry_bars") > max_expiry, beyond).otherwise(F.col("expiry_bars"))
    return orders.withColumn("expiry_bars", kept), max_expiry


def _fills(orders: DataFrame, numbered: DataFrame, reach: int) -> DataFrame:
    """Add fill state of limit orders: `_fill`, the position of the bar that filled them, status and its time."""
    placed = on_bars(orders, numbered)
    up, down = F.when(~_buy(), F.col("entry")), F.when(_buy(), F.col("entry"))
    first, last = F.col("_at_no") + 1, F.col("_at_no") + F.col("expiry_bars")
    met = passage.first_passage(placed.withColumn("_q", passage.question(first, last, up, down)), _line(numbered), reach)
    spent = F.col("_last").isNotNull() | (F.col("expiry_bars") < 1)
    status = (
        F.when(F.col("_at_no").isNull(), "NO_BAR")
        .when(F.col("_hit").isNotNull(), "FILLED")
        .when(spent, "EXPIRED")
        .otherwise("PENDING")
    )
    at = F.coalesce(F.col("_hit.bar_ts"), F.col("_last.bar_ts"))
    return met.select(*orders.columns, F.col(f"_hit.{NO}").alias("_fill"), status.alias("status"), at.alias("status_ts"))


def _line(numbered: DataFrame) -> DataFrame:
    return numbered.select(*SERIES, NO, passage.bar_struct().alias("_bar"))


def limit_fill(orders: DataFrame, bars: DataFrame, max_expiry: int | None = None) -> DataFrame:
    """Fill or expiry of limit orders; NO_BAR where no bar lies at or before the order.

    `max_expiry` bounds the search; without it the largest `expiry_bars` is looked up first. One order that
    asks for very many bars costs the others nothing: only its own search goes on past its tile.
    """
    orders, reach = _within(orders, max_expiry)
    return _public(_fills(orders, number_bars(bars), reach))


def order_outcome(orders: DataFrame, bars: DataFrame, max_expiry: int | None, horizon: int) -> DataFrame:
    """Fill, then profit, loss or time-out within `horizon` bars after the fill bar."""
    orders, reach = _within(orders, max_expiry)
    numbered = number_bars(bars)
    filled = _fills(orders, numbered, reach)
    up, down = F.when(_buy(), F.col("tp")).otherwise(F.col("sl")), F.when(_buy(), F.col("sl")).otherwise(F.col("tp"))
    rest = passage.question(F.col("_fill") + 1, F.col("_fill") + horizon, up, down)
    met = passage.first_passage(filled.withColumn("_q", rest), _line(numbered), horizon)
    stopped = F.when(_buy(), F.col("_hit.low") <= F.col("sl")).otherwise(F.col("_hit.high") >= F.col("sl"))
    outcome = (
        F.when(F.col("status") != "FILLED", F.col("status"))
        .when(F.col("_hit").isNull() & F.col("_last").isNull(), "OPEN")
        .when(F.col("_hit").isNull(), "TIMEOUT")
        .when(stopped, "SL")
        .otherwise("TP")
    )
    return _public(_with_pnl(met.withColumn("outcome", outcome), F.col("_last.close")))


def valid_order() -> Column:
    """Stop, entry and target in the order that the side asks for, and a positive expiry."""
    buy = _buy() & (F.col("sl") < F.col("entry")) & (F.col("entry") < F.col("tp"))
    sell = (
        (F.col("side") == "SELL_LIMIT")
        & (F.col("tp") < F.col("entry"))
        & (F.col("entry") < F.col("sl"))
    )
    sound = (buy | sell) & (F.col("expiry_bars") >= 1) & (F.least("sl", "entry", "tp") > 0)
    return F.coalesce(sound, F.lit(False))


def expectancy(df: DataFrame) -> DataFrame:
    """Add `ev`: chance-weighted gain less loss, friction deducted."""
    gain, loss = F.abs(F.col("tp") - F.col("entry")), F.abs(F.col("entry") - F.col("sl"))
    return df.withColumn(
        "ev", F.col("p_win") * gain - (1 - F.col("p_win")) * loss - F.col("friction")
    )


def expectancy_filter(df: DataFrame) -> DataFrame:
    return expectancy(df).filter(F.col("ev") > 0)
