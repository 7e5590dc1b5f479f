from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from frames import T0, bars_df, bars_pdf, path_bars
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.operators import features as ft
from barloom.operators import samples

OUT = [
    "body_ratio", "upper_wick", "lower_wick", "range_to_atr", "natr", "vol_expansion", "ema_z", "rsi",
    "macd", "macd_signal", "macd_hist", "bb_width", "close_scaled",
]


def full(df, **kw):
    return ft.compute(df, *ft.full_set(), **kw)


def frame(df):
    return df.toPandas().sort_values(["symbol", "bar_ts"]).reset_index(drop=True)


def test_against_pandas(spark):
    pdf = bars_pdf(300)
    got = frame(full(bars_df(spark, pdf)))
    for _, g in got.groupby("symbol"):
        close = g["close"]
        assert np.allclose(g["ema"], close.ewm(span=12, adjust=False).mean())
        atr = g["tr"].ewm(alpha=1 / 14, adjust=False).mean()
        assert np.allclose(g["atr"], atr)
        macd = (close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()) / close
        assert np.allclose(g["macd_signal"], macd.ewm(span=9, adjust=False).mean())
        mean, std = close.rolling(50, min_periods=20).mean().shift(), close.rolling(50, min_periods=20).std().shift()
        assert np.allclose(g["close_scaled"], (close - mean) / std, equal_nan=True)
    assert np.allclose(got["body_ratio"] + got["upper_wick"] + got["lower_wick"], 1)


def test_tile_size_does_not_matter(spark):
    df = bars_df(spark, bars_pdf(700, symbols=("A",)))
    one, many = frame(full(df)), frame(full(df, size=64))
    assert len(one) == len(many) == 700
    for c in OUT:
        assert np.allclose(one[c], many[c], rtol=0, atol=1e-9, equal_nan=True), c


def test_average_reads_what_it_declares():
    for alpha in (0.5, 2 / 13, 1 / 14, 0.02, 0.001):
        rows = ft.average_rows(alpha) + 1
        assert (1 - alpha) ** (rows - 1) <= ft.TAIL
        assert np.prod(ft.radices(alpha)) == rows - 1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(min_value=0.01, max_value=1000))
def test_scale_free(spark, factor):
    pdf = bars_pdf(90, symbols=("A",))
    scaled = pdf.copy()
    scaled[["open", "high", "low", "close"]] *= factor
    a, b = frame(full(bars_df(spark, pdf))), frame(full(bars_df(spark, scaled)))
    for c in OUT:
        assert np.allclose(a[c], b[c], rtol=1e-6, atol=1e-6, equal_nan=True), c


def test_flat_prices_divide_by_nothing(spark):
    got = frame(full(path_bars(spark, [(5, 5, 5, 5)] * 60)))
    assert (got[["body_ratio", "upper_wick", "lower_wick", "rsi", "macd"]] == 0).all().all()
    assert got["range_to_atr"].isna().all() and got["ema_z"].isna().all()


def test_causal(spark):
    df = bars_df(spark, bars_pdf(150))
    cut = F.lit(T0 + dt.timedelta(hours=100)).cast("timestamp_ntz")
    assert samples.causality_diff(full, df, cut, OUT).count() == 0


def test_leak_is_found(spark):
    df = bars_df(spark, bars_pdf(150))
    cut = F.lit(T0 + dt.timedelta(hours=100)).cast("timestamp_ntz")
    leaky = ft.Feature(("ahead",), 0, (ft.Stage({"ahead": lambda w: F.lead("close").over(w)}),), after=1)
    diff = samples.causality_diff(lambda b: ft.compute(b, leaky), df, cut, ["ahead"])
    assert diff.count() == 2  # the last bar before the cut of each symbol


def test_sessions_follow_local_clocks(spark):
    stamps = [dt.datetime(2024, 1, 10, 7, 30), dt.datetime(2024, 7, 10, 7, 30), dt.datetime(2024, 7, 10, 13, 30),
              dt.datetime(2024, 1, 10, 16, 30), dt.datetime(2024, 3, 20, 12, 30), dt.datetime(2024, 1, 10, 0, 30)]
    pdf = bars_pdf(len(stamps), symbols=("A",))
    pdf["bar_ts"] = stamps
    got = ft.compute(bars_df(spark, pdf), ft.session_masks()).toPandas().set_index("bar_ts")
    london = got["london"]
    assert not london[stamps[0]] and london[stamps[1]]  # 07:30 UTC is 08:30 in London in July only
    assert got["ny_overlap"][stamps[2]]
    assert got["london_close"][stamps[3]]
    assert got["ny_overlap"][stamps[4]]  # New York is on summer time, London is not yet
    assert got["asian"][stamps[5]] and not got["asian"][stamps[2]]


@pytest.mark.parametrize(
    "ts,is_open",
    [
        (dt.datetime(2024, 3, 8, 21, 59), True), (dt.datetime(2024, 3, 8, 22, 0), False),
        (dt.datetime(2024, 3, 9, 12, 0), False), (dt.datetime(2024, 3, 10, 20, 59), False),
        (dt.datetime(2024, 3, 10, 21, 0), True), (dt.datetime(2024, 3, 15, 21, 0), False),
    ],
)
def test_market_hours_over_dst(spark, ts, is_open):
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    assert df.select(clock.market_open("ts")).first()[0] is is_open


def test_windows_and_labels(spark):
    pdf = bars_pdf(40, symbols=("A",))
    df = bars_df(spark, pdf)
    made = samples.windows(df, ["close"], length=5, horizon=3).orderBy("bar_ts").collect()
    assert len(made) == 40 - 4 - 3
    close = pdf["close"].tolist()
    assert [x.close for x in made[0].x] == close[:5] and made[0].y == close[7]
    labels = samples.forward_labels(df, 2).orderBy("bar_ts").collect()
    assert len(labels) == 38
    assert labels[3].next_up == (close[5] > close[3])


def test_quantile_baseline(spark):
    pdf = bars_pdf(80, symbols=("A",))
    got = samples.quantile_baseline(bars_df(spark, pdf), win=30).toPandas().sort_values("bar_ts")
    ret = pdf["close"].pct_change(fill_method=None)
    want = ret.rolling(30, min_periods=20).quantile(0.9).shift() * pdf["close"].shift() + pdf["close"].shift()
    assert np.allclose(got["q90"], want.dropna())
    assert (got["q10"] <= got["q50"]).all() and (got["q50"] <= got["q90"]).all()


def test_stationarity_blocks_equal_ntile(spark):
    df = bars_df(spark, bars_pdf(43))
    got = samples.stationarity(df, ["close"], 5).toPandas()
    assert sorted(got["n"].tolist()) == sorted([9, 9, 9, 8, 8] * 2)
