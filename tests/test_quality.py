from __future__ import annotations

import datetime as dt

import pytest
from frames import T0, at, bars_df, bars_pdf, ticks_df
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import clock
from barloom.operators import bars
from barloom.operators import quality as q
from barloom.operators import slices as sl
from barloom.sources import files


def stamps(df, c="bar_ts"):
    return sorted(r[c] for r in df.collect())


def test_bar_checks_flag_only_planted_rows(spark):
    pdf = bars_pdf(60, symbols=("A",))
    pdf.loc[5, "low"] = -1.0
    pdf.loc[9, ["open", "high", "low", "close"]] = 0.0
    pdf.loc[14, "spread"] = -0.1
    pdf.loc[20, "high"] = pdf.loc[20, "low"] - 1
    got = q.validate(bars_df(spark, pdf), q.bar_checks())
    bad = {r.bar_ts: r.violations for r in got.filter(F.size("violations") > 0).collect()}
    hour = lambda i: T0 + dt.timedelta(hours=i)
    assert bad == {hour(5): ["price"], hour(9): ["price"], hour(14): ["spread"], hour(20): ["ohlc"]}
    clean, quarantined = q.split(got)
    assert clean.count() == 56 and quarantined.count() == 4


def test_tick_checks(spark):
    rows = [(i, "A", at(i), 10.0, 0.1) for i in range(30)]
    rows[12] = (12, "A", at(12), -1.0, 0.1)
    rows[15] = (15, "A", at(15), 10.0, 5.0)
    rows[20], rows[21] = (20, "A", at(21), 10.0, 0.1), (21, "A", at(20), 10.0, 0.1)
    df = ticks_df(spark, rows)
    chunk = F.floor(F.col("tick_id") / 4)
    got = q.checked_ticks(df, ["tick_id"], chunk, n=9, k=3.0).filter(F.size("violations") > 0)
    assert {r.tick_id: r.violations for r in got.collect()} == {12: ["price"], 15: ["spread"], 21: ["order"]}


def test_gaps_skip_the_weekend(spark):
    # Thursday 2024-03-07 to Tuesday; the market closes at 22:00 UTC on Friday.
    pdf = bars_pdf(120, symbols=("A",), start=dt.datetime(2024, 3, 7))
    open_ = lambda t: not (
        dt.datetime(2024, 3, 8, 22) <= t < dt.datetime(2024, 3, 10, 21)
    )
    pdf = pdf[[open_(t) for t in pdf["bar_ts"]]]
    lost = [dt.datetime(2024, 3, 11, h) for h in (3, 4, 5)]
    df = bars_df(spark, pdf[~pdf["bar_ts"].isin(lost)])
    gaps = q.find_gaps(df, "H1").collect()
    assert [(g.gap_start.hour, g.gap_end.hour, g.missing) for g in gaps] == [(2, 6, 3)]
    assert stamps(q.missing_slots(df, "H1")) == lost


def test_dedupe_and_slice_edges(spark):
    pdf = bars_pdf(20, symbols=("A",))
    first, second = pdf.iloc[:12], pdf.iloc[10:].copy()
    second["close"] += 1000
    got = sl.union_slices(bars_df(spark, first), bars_df(spark, second))
    rows = {r.bar_ts: r.close for r in got.collect()}
    assert len(rows) == got.count() == 20
    assert rows[T0 + dt.timedelta(hours=11)] > 900 > rows[T0 + dt.timedelta(hours=9)]


def test_slices(spark):
    symbols = spark.createDataFrame([("A",)], "symbol string")
    plan = sl.plan_slices(symbols, dt.datetime(2020, 1, 1), dt.datetime(2022, 7, 1), "1 year")
    assert [(r.lo.year, r.hi) for r in plan.orderBy("lo").collect()] == [
        (2020, dt.datetime(2021, 1, 1)), (2021, dt.datetime(2022, 1, 1)), (2022, dt.datetime(2022, 7, 1)),
    ]
    part = sl.plan_slices(symbols, T0, T0 + dt.timedelta(days=3), "1 day")
    got = sl.slice_coverage(part, bars_df(spark, bars_pdf(30, symbols=("A",))), 24, "H1")
    assert [(r.n, r.is_empty, r.at_cap) for r in got.orderBy("lo").collect()] == [
        (24, False, True), (6, False, False), (0, True, False),
    ]


def test_utc_sort(spark):
    df = ticks_df(spark, [(1, "A", dt.datetime(2024, 7, 1, 12), 1.0, 0.1)])
    assert q.sort_utc(df, "ts", "America/New_York").first().ts == dt.datetime(2024, 7, 1, 16)


def test_health_report_totals(spark):
    pdf = bars_pdf(10)
    pdf.loc[0, "spread"] = 0.0
    report = q.health_report(q.validate(bars_df(spark, pdf), q.bar_checks()), ["price", "spread", "ohlc"])
    total = report.filter("level = 3").first()
    assert (total.n, total.bad, total.bad_spread) == (20, 1, 1)
    assert report.filter("symbol = 'A' and level = 1").first().bad == 1


def test_corrupt_text_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "ticks.csv"
    path.write_text("1,A,2024-03-04T00:00:00,1.5,0.1\nx,A,never,1.5,0.1\n")
    good, bad = files.split_corrupt(files.read_ticks(spark, str(path), "csv").cache())
    assert good.count() == 1 and bad.count() == 1
    assert good.first().price == 1.5


def test_store_takes_batches_once(spark, tmp_path):
    one, two = bars_df(spark, bars_pdf(30)), bars_df(spark, bars_pdf(40, symbols=("A", "C"), seed=2, tf="M5"))
    path = str(tmp_path / "store")
    files.write_immutable(one, path, "1")
    files.write_immutable(two, path, "2")
    with pytest.raises(Exception, match="already exists"):
        files.write_immutable(one, path, "1")
    stored = files.read_store(spark, path, schemas.BARS)
    for batch, df in (("1", one), ("2", two)):
        back = schemas.require(stored.filter(F.col("batch") == batch), schemas.BARS)
        assert back.count() == df.count() and back.exceptAll(df).count() == 0
    plan = stored.filter("symbol = 'A'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_store_refuses_a_slice_that_it_has(spark, tmp_path):
    pdf, path = bars_pdf(48), str(tmp_path / "store")
    bars = bars_df(spark, pdf)
    middle = F.lit(pdf.bar_ts.iloc[24].to_pydatetime()).cast("timestamp_ntz")
    files.write_immutable(bars.filter(F.col("bar_ts") < middle), path, "1")
    with pytest.raises(ValueError, match="overlaps batch 1"):
        files.write_immutable(bars.filter("symbol = 'A'"), path, "2")
    assert files.read_store(spark, path, schemas.BARS).count() == 48  # the refused batch is not seen
    files.write_immutable(bars.filter(F.col("bar_ts") >= middle), path, "2")  # and makes way for another try
    stored = files.read_store(spark, path, schemas.BARS)
    assert schemas.require(stored, schemas.BARS).exceptAll(bars).count() == 0 and stored.count() == 96
    found = files.slices(spark, path).groupBy("batch").agg(F.sum("rows").alias("n")).collect()
    assert {r.batch: r.n for r in found} == {"1": 48, "2": 48}


def test_unfinished_batch_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert files.read_store(spark, path, schemas.BARS).count() == 0
    monkeypatch.setattr(files, "_renamed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        files.write_immutable(bars_df(spark, bars_pdf(5)), path, "1")
    assert files.read_store(spark, path, schemas.BARS).count() == 0


def test_two_writers_take_different_places(spark, tmp_path, monkeypatch):
    path, rename = str(tmp_path / "store"), files._renamed
    other = bars_df(spark, bars_pdf(5, symbols=("C",)))

    def late(*a):
        monkeypatch.setattr(files, "_renamed", rename)
        files.write_immutable(other, path, "2")  # comes in between
        return rename(*a)

    monkeypatch.setattr(files, "_renamed", late)
    files.write_immutable(bars_df(spark, bars_pdf(5)), path, "1")
    assert files.read_store(spark, path, schemas.BARS).count() == 15


def test_range_reads_what_the_manifest_has(spark, tmp_path):
    path = str(tmp_path / "store")
    for year, batch in ((2021, "a"), (2022, "b"), (2023, "c")):
        files.write_immutable(bars_df(spark, bars_pdf(30, start=dt.datetime(year, 5, 1))), path, batch)
    part = files.read_store(spark, path, schemas.BARS, dt.datetime(2022, 1, 1), dt.datetime(2022, 5, 1, 10))
    assert part.count() == 20 and {f.split("batch=")[1][0] for f in part.inputFiles()} == {"b"}


def test_parquet_without_a_column_is_refused(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_df(spark, bars_pdf(3)).drop("spread").write.parquet(path)
    with pytest.raises(ValueError, match="spread"):
        files.read_bars(spark, path)


def test_corrupt_rows_are_kept_and_named(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "A", at(1), 10.0, 0.1), (2, None, at(2), 10.0, 0.1), (3, "A", None, 10.0, 0.1), (4, "A", at(4), nan, 0.1),
        (5, "A", at(5), inf, 0.1), (6, "A", at(6), None, 0.1), (7, "A", at(7), 10.0, nan), (8, None, None, None, None),
    ]
    got = q.checked_ticks(ticks_df(spark, rows), ["tick_id"], F.floor(F.col("tick_id") / 3), n=9, k=3.0)
    clean, bad = q.split(got)
    assert [r.tick_id for r in clean.collect()] == [1]
    assert {r.tick_id: r.violations for r in bad.collect()} == {
        2: ["key"], 3: ["key"], 4: ["price"], 5: ["price"], 6: ["price"], 7: ["spread"], 8: ["key", "price", "spread"],
    }
    total = q.health_report(got, ["key", "price", "spread", "order"], ["symbol"]).filter("level = 1").first()
    assert (total.n, total.bad, total.bad_key) == (8, 7, 3)


def test_timeframes_do_not_mix(spark):
    hours = bars_pdf(48, symbols=("A",), tf="H1", start=dt.datetime(2024, 3, 5))
    fives = bars_pdf(48 * 12, symbols=("A",), tf="M5", hours=1 / 12, start=dt.datetime(2024, 3, 5))
    lost = dt.datetime(2024, 3, 5, 7)
    mixed = bars_df(spark, hours[hours["bar_ts"] != lost]).unionByName(bars_df(spark, fives))
    assert stamps(q.missing_slots(mixed, "H1")) == [lost]
    assert [(g.gap_start.hour, g.missing) for g in q.find_gaps(mixed, "H1").collect()] == [(6, 1)]
    wide = bars.resample(mixed, "H4", "H1").agg(F.sum("volume")).first()[0]
    assert wide == int(hours[hours["bar_ts"] != lost]["volume"].sum())


def test_schema_check(spark):
    with pytest.raises(ValueError, match="volume"):
        schemas.require(bars_df(spark, bars_pdf(3)).drop("volume"), schemas.BARS)


def test_market_clock_is_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 1),)], "ts timestamp_ntz")
    assert df.select(clock.seconds("ts")).first()[0] == 60
