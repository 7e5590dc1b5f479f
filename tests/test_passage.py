"""First passage against a walk over every bar, over several tiles and with long ranges."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from frames import T0, bars_df, bars_pdf
from pyspark.sql import functions as F

from barloom.operators import labels, passage, tiles
from barloom.operators.tiles import NO


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(passage, "HALO", 5)


def walk(line, first, last, up, down):
    """(first bar of line[first..last] that reaches a level, else bar at last)."""
    hit = None
    for p in range(max(first, 0), min(last, len(line) - 1) + 1):
        high, low = line[p]
        if (up is not None and high is not None and (high >= up or math.isnan(high))) or (
            down is not None and low is not None and low <= down
        ):
            hit = p
            break
    return hit, last if hit is None and first <= last < len(line) else None


@pytest.mark.parametrize(("reach", "crowd"), [(4, 200_000), (5000, 3)])
def test_passage_equals_walk(spark, monkeypatch, small, reach, crowd):
    monkeypatch.setattr(passage, "CROWD", crowd)
    rng = random.Random(reach)
    series = {}
    for symbol, n in (("A", 120), ("B", 17), ("C", 1)):
        x, line = 100.0, []
        for _ in range(n):
            x += rng.gauss(0, 1)
            line.append(rng.choice([(x + 1, x - 1)] * 20 + [(None, x - 1), (x + 1, None), (float("nan"), x - 1)]))
        series[symbol] = line
    rows = [(s, "H1", p, (p, h, lo)) for s, line in series.items() for p, (h, lo) in enumerate(line)]
    bars = spark.createDataFrame(rows, f"symbol string, tf string, {NO} long, _bar struct<{NO}:long,high:double,low:double>")
    asked = []
    for k in range(200):
        s = rng.choice("ABCD")
        first = rng.randrange(120)
        up, down = 100 + rng.random() * 40, 100 - rng.random() * 40
        last = first + rng.randrange(-1, reach)
        asked.append((s, "H1", k, (first, last, rng.choice([up, up, None]), rng.choice([down, down, None]))))
    asked += [(None, "H1", 500, (1, 2, 1.0, 1.0)), ("A", "H1", 501, (None, 3, 0.0, 0.0)), ("A", "H1", 502, None)]
    questions = spark.createDataFrame(
        asked, "symbol string, tf string, k int, _q struct<first:long,last:long,up:double,down:double>"
    )
    found = passage.first_passage(questions, bars, reach).collect()
    want = {}
    for s, _, k, q in asked:
        known = s is not None and q is not None and q[0] is not None
        want[k] = walk(series.get(s, []), *q) if known else (None, None)
    got = {r.k: tuple(x and x[NO] if x is not None else None for x in (r["_hit"], r["_last"])) for r in found}
    assert len(found) == len(asked)
    assert {k: (h if h is None else int(h), last if last is None else int(last)) for k, (h, last) in got.items()} == want


@pytest.mark.parametrize("horizon", [3, 2000])
def test_barriers_over_many_tiles(spark, small, horizon):
    pdf = bars_pdf(70, seed=4)
    got = labels.triple_barrier(bars_df(spark, pdf), F.lit(6.0), F.lit(5.0), horizon).collect()
    assert len(got) == len(pdf)
    for symbol, part in pdf.groupby("symbol"):
        line = list(zip(part.high, part.low, strict=True))
        by_time = {r.bar_ts: r for r in got if r.symbol == symbol}
        times = [t.to_pydatetime() for t in part.bar_ts]
        for p, (ts, close) in enumerate(zip(times, part.close, strict=True)):
            hit, last = walk(line, p + 1, p + horizon, close + 6.0, close - 5.0)
            want = 0 if hit is None and last is not None else None if hit is None else -1 if line[hit][1] <= close - 5.0 else 1
            assert (by_time[ts].label, by_time[ts].touch_ts) == (want, None if hit is None else times[hit])


def test_stray_bars_keep_their_row(spark):
    pdf = bars_pdf(5, symbols=("A",))
    bars = bars_df(spark, pdf).withColumn("symbol", F.when(F.hour("bar_ts") != 2, F.col("symbol")))
    got = labels.triple_barrier(bars, F.lit(1.0), F.lit(1.0), 3).collect()
    assert len(got) == 5 and all(r.label is None and r.tp_level is not None for r in got if r.symbol is None)


def test_one_long_order_beside_short_ones(spark, small):
    """A huge expiry is searched for on its own; odd expiries have a defined state."""
    n = 90
    pdf = bars_pdf(n, symbols=("A",), seed=6)
    low = list(pdf.low)
    at = lambda p: T0 + dt.timedelta(hours=p)
    expiries = [1, 2, 60, 10**9, 0, None]
    rows = [("A", "H1", at(3 + k), "BUY_LIMIT", low[3 + k] - 3.0, e) for k, e in enumerate(expiries)]
    orders = spark.createDataFrame(rows, "symbol string, tf string, bar_ts timestamp_ntz, side string, entry double, expiry_bars int")
    got = {r.expiry_bars: r for r in labels.limit_fill(orders, bars_df(spark, pdf)).collect()}
    for k, e in enumerate(expiries):
        if e is None:
            assert got[e].status == "PENDING" and got[e].status_ts is None
            continue
        hit, last = walk([(None, x) for x in low], 4 + k, 3 + k + e, None, low[3 + k] - 3.0)
        want = "FILLED" if hit is not None else "EXPIRED" if last is not None or e < 1 else "PENDING"
        when = at(hit) if hit is not None else at(last) if last is not None and e > 0 else None
        assert (got[e].status, got[e].status_ts) == (want, when)
