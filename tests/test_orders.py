"""Barriers, limit orders, policy, sizing."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from frames import T0, bars_df, bars_pdf, path_bars
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import features as ft
from barloom.operators import joins, labels, policy, risk

FLAT = (10, 10.4, 9.6, 10)


def hour(i):
    return T0 + dt.timedelta(hours=i)


@pytest.mark.parametrize(
    "rows,label,touch",
    [
        ([FLAT, FLAT, (10, 11, 9.6, 10), FLAT], 1, 2),
        ([FLAT, (10, 10.4, 9, 10), (10, 11, 9.6, 10), FLAT], -1, 1),
        ([FLAT, FLAT, (10, 11.5, 8.5, 10), FLAT], -1, 2),
        ([FLAT, FLAT, FLAT, FLAT], 0, None),
        ([FLAT, FLAT, FLAT, (10, 11, 9.6, 10)], 1, 3),
        ([FLAT, FLAT, FLAT, FLAT, (10, 11, 9.6, 10)], 0, None),
        ([FLAT, FLAT, FLAT], None, None),
        ([FLAT, (10, 11, 9.6, 10)], 1, 1),
    ],
    ids=["tp", "sl-first", "both", "time-out", "tp-at-h", "tp-after-h", "short", "short-touched"],
)
def test_barrier_paths(spark, rows, label, touch):
    got = labels.triple_barrier(path_bars(spark, rows), F.lit(1.0), F.lit(1.0), 3).orderBy("bar_ts").first()
    assert (got.label, got.touch_ts) == (label, None if touch is None else hour(touch))


def order(spark, side="BUY_LIMIT", entry=9.0, sl=8.0, tp=11.0, expiry=3, bar=0, n=1):
    rows = [(i, "A", "H1", hour(bar), side, entry, sl, tp, expiry) for i in range(n)]
    return spark.createDataFrame(
        rows, "order_id long, symbol string, tf string, bar_ts timestamp_ntz, side string, entry double, "
        "sl double, tp double, expiry_bars int",
    )


DIP = (10, 10.4, 9.0, 10)


@pytest.mark.parametrize(
    "rows,status,at",
    [
        ([FLAT, DIP, FLAT, FLAT], "FILLED", 1),
        ([FLAT, FLAT, FLAT, DIP], "FILLED", 3),
        ([FLAT, FLAT, FLAT, FLAT, DIP], "EXPIRED", 3),
        ([FLAT, (8, 8.5, 7, 8), FLAT], "FILLED", 1),
        ([FLAT, FLAT], "PENDING", None),
        ([DIP, FLAT, FLAT, FLAT], "EXPIRED", 3),
    ],
    ids=["bar-1", "bar-n", "after-n", "gap-through", "too-short", "own-bar"],
)
def test_limit_paths(spark, rows, status, at):
    got = labels.limit_fill(order(spark), path_bars(spark, rows), 3).first()
    assert (got.status, got.status_ts) == (status, None if at is None else hour(at))


@pytest.mark.parametrize(
    "rows,side,outcome,pnl",
    [
        ([FLAT, DIP, (10, 11, 9.6, 10), FLAT], "BUY_LIMIT", "TP", 2.0),
        ([FLAT, (10, 11, 9.0, 10), FLAT, FLAT, FLAT], "BUY_LIMIT", "TIMEOUT", 1.0),
        ([FLAT, DIP, (10, 11, 7.9, 10), FLAT], "BUY_LIMIT", "SL", -1.0),
        ([FLAT, DIP, FLAT], "BUY_LIMIT", "OPEN", None),
        ([FLAT, FLAT, FLAT, FLAT], "BUY_LIMIT", "EXPIRED", 0.0),
        ([FLAT, (10, 11, 10, 10), (10, 10, 9.0, 10)], "SELL_LIMIT", "TP", 2.0),
        ([FLAT, (10, 11, 10, 10), (10, 12, 10, 10)], "SELL_LIMIT", "SL", -1.0),
    ],
)
def test_outcomes(spark, rows, side, outcome, pnl):
    sell = dict(entry=11.0, sl=12.0, tp=9.0) if side == "SELL_LIMIT" else {}
    got = labels.order_outcome(order(spark, side, **sell), path_bars(spark, rows), 3, 3).first()
    assert (got.outcome, got.pnl) == (outcome, pnl)


def test_many_orders_on_one_bar(spark):
    got = labels.limit_fill(order(spark, n=50), path_bars(spark, [FLAT, DIP, FLAT, FLAT]), 3)
    assert got.count() == 50 and got.filter("status = 'FILLED'").count() == 50


def test_orders_off_the_grid_and_without_a_bar(spark):
    bars = path_bars(spark, [FLAT, DIP, FLAT, FLAT])
    off = order(spark).withColumn("bar_ts", F.col("bar_ts") + F.expr("interval 7 minutes"))
    early = order(spark).withColumn("bar_ts", F.col("bar_ts") - F.expr("interval 1 day"))
    lost = order(spark).withColumn("symbol", F.lit(None).cast("string"))
    rows = off.unionByName(early).unionByName(lost)
    got = labels.limit_fill(rows, bars, 3).collect()
    assert sorted(r.status for r in got) == ["FILLED", "NO_BAR", "NO_BAR"]
    played = labels.order_outcome(rows, bars, None, 2).collect()
    assert sorted(r.outcome for r in played) == ["NO_BAR", "NO_BAR", "TIMEOUT"]


def test_an_expiry_above_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="above 2"):
        labels.limit_fill(order(spark, expiry=5), path_bars(spark, [FLAT] * 8), 2).collect()


def brute_barrier(bars, tp, sl, h):
    out = {}
    for symbol, g in bars.sort_values("bar_ts").groupby("symbol"):
        g = g.reset_index(drop=True)
        for i in range(len(g)):
            label = None
            for j in range(i + 1, min(i + h, len(g) - 1) + 1):
                if g.low[j] <= g.close[i] - sl:
                    label = -1
                elif g.high[j] >= g.close[i] + tp:
                    label = 1
                if label is not None:
                    break
            if label is None and i + h <= len(g) - 1:
                label = 0
            out[symbol, g.bar_ts[i]] = label
    return out


@pytest.mark.parametrize("h", [3, 40])
def test_barriers_by_brute_force(spark, h):
    pdf = bars_pdf(150)
    got = labels.triple_barrier(bars_df(spark, pdf), F.lit(3.0), F.lit(2.0), h).collect()
    assert {(r.symbol, r.bar_ts): r.label for r in got} == brute_barrier(pdf, 3.0, 2.0, h)


def test_valid_orders_and_expectancy(spark):
    good, bad = order(spark), order(spark, sl=9.5)
    for df, want in ((good, True), (bad, False), (order(spark, expiry=0), False), (order(spark, "BUY"), False)):
        assert df.select(labels.valid_order()).first()[0] is want
    priced = good.withColumns({"p_win": F.lit(0.6), "friction": F.lit(0.3)})
    assert labels.expectancy(priced).first().ev == pytest.approx(0.6 * 2 - 0.4 * 1 - 0.3)
    assert labels.expectancy_filter(priced.withColumn("friction", F.lit(0.9))).count() == 0


@pytest.mark.parametrize("expiry, horizon", [(4, 10), (1, 1), (3, 40)])
def test_policy_grid_equals_single_orders(spark, expiry, horizon):
    pdf = bars_pdf(120)
    pdf.loc[[30, 31, 75], ["high", "low"]] = np.nan  # unknown prices, as NULL
    df = bars_df(spark, pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("high", "low")})
    levels = [0.2, 0.5, -0.1], [1.0, 0.3], [1.5, 0.4, 3.0]
    grid = policy.policy_grid(df, *levels, expiry, horizon).toPandas()
    rows = ft.compute(df, ft.atr(), ft.vol_expansion())
    regime = F.when(F.col("vol_expansion") > 1, "expanding").when(F.col("vol_expansion").isNotNull(), "calm")
    entry = F.col("close") - F.col("d") * F.col("atr")
    settings = spark.createDataFrame([(d, s, t) for d in levels[0] for s in levels[1] for t in levels[2]], "d double, s double, t double")
    orders = rows.crossJoin(settings).select(
        "symbol", "tf", "bar_ts", "atr", "d", "s", "t", regime.alias("regime"), F.lit("BUY_LIMIT").alias("side"), entry.alias("entry"),
        (entry - F.col("s") * F.col("atr")).alias("sl"), (entry + F.col("t") * F.col("atr")).alias("tp"), F.lit(expiry).alias("expiry_bars"),
    )
    played = labels.order_outcome(orders, df, expiry, horizon).toPandas()
    played = played[played["pnl"].notna()]
    played["gain"], played["filled"] = played["pnl"] / played["atr"], played["status"] == "FILLED"
    want = {
        (k[0] if isinstance(k[0], str) else None, *k[1:]): (len(g), g["filled"].mean(), g["gain"].mean())
        for k, g in played.groupby(["regime", "d", "s", "t"], dropna=False)
    }
    got = {
        (r.regime if isinstance(r.regime, str) else None, r.discount, r.stop, r.target): (r.n, r.fill_rate, r.ev)
        for r in grid.itertuples() if r.n
    }
    assert len(got) > 18 and set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-9, abs=1e-9, nan_ok=True), key
    best = policy.best_policy(policy.policy_grid(df, [0.2, 0.5], [1.0], [1.5], expiry, horizon))
    assert best.count() == grid["regime"].nunique(dropna=False)


def test_policy_grid_of_no_bars(spark):
    df = bars_df(spark, bars_pdf(5)).limit(0)
    assert policy.policy_grid(df, [0.2], [1.0], [1.5], 4, 10).count() == 0


def test_sizing(spark):
    rows = [("A", 0.6), ("A", 0.2), ("B", 0.6), ("C", 0.6)]
    df = spark.createDataFrame(
        [(s, 10000.0, 100.0, 98.0, 104.0, p) for s, p in rows],
        "symbol string, equity double, entry double, sl double, tp double, p_win double",
    )
    symbols = spark.createDataFrame([("A", 10.0, 0.1, 0.01), ("B", 1.0, 0.01, 0.01)], schemas.SYMBOLS)
    got = risk.size_lots(df, 0.01, 0.25, symbols).collect()
    assert [r.kelly for r in got] == [0.25, 0, 0.25, 0.25]  # full Kelly would be 0.4
    # 1 % of 10,000 over a stop of 2 * 10, and of 2 * 1; C is not in the catalogue.
    assert [r.lots for r in got] == [5.0, 0.0, 50.0, None]


def test_a_whole_number_of_steps_is_kept(spark):
    df = spark.createDataFrame(
        [("A", 30.0, 100.0, 99.0, 103.0, 0.9)], "symbol string, equity double, entry double, sl double, tp double, p_win double"
    )
    symbols = spark.createDataFrame([("A", 1.0, 0.1, 0.01)], schemas.SYMBOLS)
    assert risk.size_lots(df, 0.01, 0.25, symbols).first().lots == 0.3


def test_align_waits_for_the_close(spark):
    fast = bars_df(spark, bars_pdf(60, symbols=("A",), tf="M5", hours=1 / 12))
    slow = bars_df(spark, bars_pdf(5, symbols=("A",)))
    slow = slow.filter(F.col("bar_ts") != F.lit(hour(2)).cast("timestamp_ntz"))  # one bar is missing
    got = joins.align(fast, slow, "M5", {"H1": ["close"]}).orderBy("bar_ts").collect()
    used = [r.h1_bar_ts for r in got]
    assert used[:11] == [None] * 11  # the first hour has not closed
    assert used[11] == hour(0)  # closes at the same moment as the fast bar
    assert used[23] == hour(1) and used[35] == hour(1) and used[47] == hour(3)
    for r in got:
        if r.h1_bar_ts is not None:
            assert r.h1_bar_ts + dt.timedelta(hours=1) <= r.bar_ts + dt.timedelta(minutes=5)
