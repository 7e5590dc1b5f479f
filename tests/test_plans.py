"""Plans that matter at scale: shuffles, partial work before them, pruned scans."""

from __future__ import annotations

import datetime as dt

import pytest
from frames import bars_df, bars_pdf
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.operators import bars, joins, labels, quality, risk, samples, tiles
from barloom.operators import features as ft
from barloom.sources import files, views

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


@pytest.fixture(scope="module")
def stored(spark):
    return views.bars(spark, FOLDER)


def test_all_features_share_one_shuffle_and_sort(stored):
    df = ft.compute(stored, *ft.full_set())
    assert shuffles(df) == 1
    assert plan(df).count("Sort [") == 1


def test_features_and_barrier_paths_share_one_shuffle(stored):
    atr = F.col("atr")
    assert shuffles(labels.triple_barrier(stored, atr, atr, 24, [ft.atr()])) == 1


def test_features_read_only_what_they_use(stored):
    text = plan(ft.compute(stored, ft.bb_width()).select("symbol", "bar_ts", "bb_width"))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "open" not in schema and "volume" not in schema and "close" in schema


def test_symbol_filter_reaches_the_scan(stored):
    text = plan(ft.compute(stored, ft.bb_width()).filter("symbol = 'view'"))
    assert "EqualTo(symbol,view)" in text


def test_bars_aggregate_before_their_shuffle(spark):
    text = plan(bars.to_bars(views.ticks(spark, FOLDER), "H1"))
    after = text[text.index("Exchange hashpartitioning"):]
    assert "partial_min_by" in after and text.count("Exchange hashpartitioning") == 1


def test_latest_rows_are_limited_before_their_shuffle(spark):
    text = plan(samples.latest(views.ticks(spark, FOLDER), ["symbol"], "ts", "tick_id"))
    assert "WindowGroupLimit" in text[text.index("Exchange hashpartitioning"):]


def test_small_tables_are_broadcast_by_size(spark):
    valued = joins.floating_pnl(views.positions(spark, FOLDER), joins.quotes(views.ticks(spark, FOLDER)))
    assert "BroadcastHashJoin" in plan(valued) and shuffles(valued) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        valued = joins.floating_pnl(views.positions(spark, FOLDER), joins.quotes(views.ticks(spark, FOLDER)))
        assert "SortMergeJoin" in plan(valued)  # the way beyond the threshold
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_window_spans_a_whole_symbol_of_rows(spark):
    df = bars_df(spark, bars_pdf(30))
    for made in (
        ft.compute(df, ft.ema()),
        quality.spread_median(views.ticks(spark, FOLDER), 5),
        risk.open_count(views.trades(spark, FOLDER), ["account_id"]),
    ):
        for line in plan(made).splitlines():
            if "Window [" in line and "_chunk" not in line and "_tile" not in line:
                raise AssertionError(line)


def test_no_cartesian_products(spark, stored):
    from barloom.plans import QUERIES

    for name in ("e1_align", "e5_purged_folds", "f5_policy_grid", "g2_permutation_test", "g3_friction_shock"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_a_range_reads_its_years_and_equals_the_whole(spark, tmp_path):
    pdf = bars_pdf(24 * 500, symbols=("A",), start=dt.datetime(2023, 10, 1))
    numbered = tiles.number_bars(bars_df(spark, pdf))
    path = str(tmp_path / "store")
    files.write_immutable(numbered, path, "1")
    stored = files.read_store(spark, path, numbered.schema)
    lo, hi = dt.datetime(2025, 1, 20), dt.datetime(2025, 2, 1)
    wanted = (ft.atr(), ft.bb_width())
    got = ft.features_between(stored, lo, hi, *wanted)
    assert "(year#" in plan(got).split("PartitionFilters: [")[1] and "2024" in plan(got)
    inside = (F.col("bar_ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("bar_ts") < F.lit(hi).cast("timestamp_ntz"))
    whole = ft.compute(numbered, *wanted).filter(inside)
    rows = [df.select("bar_ts", "atr", "bb_width").orderBy("bar_ts").collect() for df in (got, whole)]
    assert len(rows[0]) == len(rows[1]) > 200
    assert all(a.bar_ts == b.bar_ts and a.atr == pytest.approx(b.atr) and a.bb_width == pytest.approx(b.bb_width) for a, b in zip(*rows))


def test_clocks_refuse_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="New_York"):
            clock.slot("ts", 60)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
