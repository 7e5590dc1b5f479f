from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from frames import T0, bars_df, bars_pdf
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import recurrence


def brute(rows):
    value, out = None, []
    for a, b, first in rows:
        if None not in (a, b, first) and np.isfinite([a, b, first]).all():
            value = first if value is None else a * value + b
        out.append(value)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_any_steps_by_brute_force(spark, chunk):
    rng, rows = np.random.default_rng(5), []
    for key, n in (("A", 300), ("B", 65), ("C", 1)):
        for i in range(n):
            a, b, first = (float(v) for v in (rng.uniform(-1.1, 1.1), rng.normal(), rng.normal()))
            odd = rng.random()
            rows.append((key, i, a if odd > 0.1 else None, b if odd < 0.95 else float("nan"), first if i > 2 else None))
    df = spark.createDataFrame(rows, "k string, i long, a double, b double, first double")
    stray = spark.createDataFrame([(None, 1, 0.5, 0.5, 0.5), ("A", None, 0.5, 0.5, 0.5)], df.schema)
    steps = [recurrence.Recurrence("x", F.col("a"), F.col("b"), F.col("first")), recurrence.average("e", "b", 0.3)]
    got = recurrence.recur(df.unionByName(stray).repartition(4), ["k"], ["i"], F.floor(F.col("i") / chunk), steps)
    assert got.columns == [*df.columns, "x", "e"]
    found = {(r.k, r.i): (r.x, r.e) for r in got.collect()}
    assert len(found) == len(rows) + 2 and found[None, 1] == found["A", None] == (None, None)
    for key in "ABC":
        mine = [r for r in rows if r[0] == key]
        wants = brute([r[2:] for r in mine]), brute([(0.7, None if r[3] is None else 0.3 * r[3], r[3]) for r in mine])
        for r, *want in zip(mine, *wants):
            numbers = [[np.nan if v is None else v for v in values] for values in (found[key, r[1]], want)]
            assert numbers[0] == pytest.approx(numbers[1], rel=1e-9, abs=1e-9, nan_ok=True), r
    assert recurrence.recur(df.limit(0), ["k"], ["i"], F.col("i"), steps).count() == 0


def test_equals_the_unrolled_averages_and_reads_its_chunks_only(spark, tmp_path):
    df = bars_df(spark, bars_pdf(700))
    steps = [recurrence.average("e", "close", 2 / 13)]
    want = {(r.symbol, r.bar_ts): r.ema for r in ft.compute(df, ft.ema(n=12)).collect()}
    whole = recurrence.bar_averages(df, steps, size=50).collect()
    assert {(r.symbol, r.bar_ts): r.e for r in whole} == pytest.approx(want)
    carried = recurrence.bar_carries(df, steps, 50)
    lo, hi = T0 + dt.timedelta(hours=333), T0 + dt.timedelta(hours=512)
    # What lies before the chunk of the range is not looked at.
    spoilt = df.withColumn("close", F.when(F.col("bar_ts") < F.lit(lo - dt.timedelta(hours=50)).cast("timestamp_ntz"), -1e9).otherwise(F.col("close")))
    ranged = recurrence.bar_averages_between(spoilt, carried, lo, hi, steps, 50).collect()
    assert {(r.symbol, r.bar_ts): r.e for r in ranged} == pytest.approx({k: v for k, v in want.items() if lo <= k[1] < hi})
    assert len(ranged) > 100
