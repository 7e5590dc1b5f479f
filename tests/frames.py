"""Hand-made frames and brute-force helpers."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from barloom import schemas

T0 = dt.datetime(2024, 3, 4)


def bars_pdf(n=120, symbols=("A", "B"), seed=0, tf="H1", hours=1.0, start=T0):
    """Random-walk bars without gaps."""
    rng = np.random.default_rng(seed)
    out = []
    for symbol in symbols:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = np.r_[100.0, close[:-1]]
        high = np.maximum(open_, close) + rng.random(n)
        low = np.minimum(open_, close) - rng.random(n)
        out.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "tf": tf,
                    "bar_ts": [start + dt.timedelta(hours=hours * i) for i in range(n)],
                    "open": open_, "high": high, "low": low, "close": close,
                    "volume": rng.integers(1, 100, n),
                    "spread": rng.random(n) + 0.01,
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def bars_df(spark, pdf):
    return spark.createDataFrame(pdf[schemas.BARS.names], schemas.BARS)


def path_bars(spark, rows, symbol="A"):
    """Bars from (open, high, low, close) rows, one hour apart."""
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"], dtype="float64")
    pdf["symbol"], pdf["tf"], pdf["volume"], pdf["spread"] = symbol, "H1", 1, 0.1
    pdf["bar_ts"] = [T0 + dt.timedelta(hours=i) for i in range(len(pdf))]
    return bars_df(spark, pdf)


def ticks_df(spark, rows):
    """Ticks from (tick_id, symbol, ts, price, spread)."""
    return spark.createDataFrame(rows, schemas.TICKS)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)
