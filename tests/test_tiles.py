from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from frames import T0, at, bars_df, bars_pdf
from pyspark.sql import functions as F

from barloom import session
from barloom.functions.clock import slot
from barloom.operators import tiles


def test_number_is_dense_across_chunks(spark):
    df = bars_df(spark, bars_pdf(100).sample(frac=1, random_state=1))
    got = tiles.number(df, ["symbol", "tf"], ["bar_ts"], slot("bar_ts", 7 * 3600)).toPandas()
    for _, g in got.sort_values("bar_ts").groupby("symbol"):
        assert g["bar_no"].tolist() == list(range(100))


@pytest.mark.parametrize("size,before,after", [(7, 0, 0), (7, 3, 2), (5, 12, 9), (1000, 4, 4)])
def test_tiles_give_whole_frames(spark, size, before, after):
    df = bars_df(spark, bars_pdf(60))

    def compute(d, w):
        return d.withColumn("s", F.sum("volume").over(w.rowsBetween(-before, after)))

    got = tiles.tiled(tiles.number_bars(df), compute, before, after, size=size).toPandas()
    assert len(got) == 120
    for _, g in got.sort_values("bar_ts").groupby("symbol"):
        v = g["volume"].to_numpy()
        want = [v[max(0, i - before): i + after + 1].sum() for i in range(len(v))]
        assert g["s"].tolist() == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_cumulative(spark, inclusive):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "k": rng.choice(["x", "y"], 200, p=[0.9, 0.1]),
            "ts": [at(int(m)) for m in rng.integers(0, 500, 200)],
            "id": range(200),
            "v": np.where(rng.random(200) < 0.3, np.nan, rng.integers(-9, 9, 200)),
        }
    )
    df = spark.createDataFrame(pdf, "k string, ts timestamp_ntz, id long, v double")
    df = df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    scans = [tiles.Scan(f, f, F.col("v")) for f in ("sum", "max", "min", "last")]
    got = tiles.running(df, ["k"], ["ts", "id"], slot("ts", 600), scans, inclusive).toPandas()
    for _, g in got.sort_values(["ts", "id"]).groupby("k"):
        seen = []
        for row in g.itertuples():
            now = seen + ([row.v] if inclusive and not np.isnan(row.v) else [])
            for name, fn in (("sum", sum), ("max", max), ("min", min), ("last", lambda s: s[-1])):
                have = getattr(row, name)
                assert (np.isnan(have) and not now) or have == fn(now)
            if not np.isnan(row.v):
                seen.append(row.v)


def test_asof_matches_merge_asof(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"s": rng.choice(["a", "b"], 150), "t": [at(float(m)) for m in rng.integers(0, 900, 150)], "i": range(150)})
    right = pd.DataFrame({"s": rng.choice(["a", "b"], 40), "u": [at(float(m)) for m in rng.integers(100, 900, 40)], "p": rng.random(40)})
    right = right.drop_duplicates(["s", "u"])
    got = tiles.asof(
        spark.createDataFrame(left, "s string, t timestamp_ntz, i long"),
        spark.createDataFrame(right, "s string, u timestamp_ntz, p double"),
        ["s"], "t", "u", ["u", "p"], grain=1800,
    ).toPandas().sort_values("i")
    want = pd.merge_asof(
        left.astype({"t": "datetime64[us]"}).sort_values("t"), right.astype({"u": "datetime64[us]"}).sort_values("u"),
        left_on="t", right_on="u", by="s",
    ).sort_values("i")
    assert np.allclose(got["p"], want["p"], equal_nan=True)
    assert got["i"].tolist() == want["i"].tolist()
    assert got["p"].isna().any()  # some left rows precede every right row


def test_asof_order_breaks_ties(spark):
    left = spark.createDataFrame([("a", T0, 1)], "s string, t timestamp_ntz, i long")
    right = spark.createDataFrame([("a", T0, 5, 1.0), ("a", T0, 6, 2.0)], "s string, u timestamp_ntz, n long, p double")
    got = tiles.asof(left, right, ["s"], "t", "u", ["p"], 60, right_order=["n"]).collect()
    assert [r.p for r in got] == [2.0]


def test_stored_tables_lie_in_the_applications_folder(spark):
    df = session.store(spark.range(3).toDF("x"), "numbers")
    assert df.count() == 3
    folder = session.own_dir(spark)
    assert spark.sparkContext.applicationId in folder and f"{folder}/numbers-" in df.inputFiles()[0]
