"""Streams against their batch twins, over several batches and restarts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from frames import at, bars_df, bars_pdf
from pyspark.sql import functions as F
from test_risk_validation import ENDS, LOG, log_df, offers, offers_df

from barloom import schemas
from barloom.operators import bars as bar_ops
from barloom.operators import features as ft
from barloom.operators import models, risk
from barloom.session import fresh_dir
from barloom.sources import files
from barloom.streaming import orders as order_streams
from barloom.streaming import sinks
from barloom.streaming import ticks as tick_streams


def ticks_pdf(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    minutes = np.sort(rng.random(n) * 600)
    rows = [(i, str(rng.choice(["A", "B"])), at(float(m)), float(rng.random()), 0.1) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, schemas.TICKS)


def drain(stream, path, mode="append"):
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(cols), b.select(cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bars_over_restarts(spark, tmp_path):
    ticks = ticks_pdf(spark)
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    for lo, hi in ((0, 150), (150, 300), (300, 601)):
        part = ticks.filter((F.col("ts") >= F.lit(at(lo)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(at(hi)).cast("timestamp_ntz")))
        part.write.mode("append").parquet(src)
        # Every drain is a new query on the same checkpoint.
        drain(tick_streams.bars_stream(files.stream_ticks(spark, src), "M5", "10 minutes"), path)
    got = spark.read.parquet(f"{path}/out")
    newest = ticks.agg(F.max("ts")).first()[0]
    batch = bar_ops.to_bars(ticks, "M5")
    closed = batch.filter(F.col("bar_ts") + F.expr("interval 15 minutes") <= F.lit(newest).cast("timestamp_ntz"))
    assert got.count() > 100 and same(got, closed)


def test_forming_bars_and_duplicates(spark, tmp_path):
    ticks = ticks_pdf(spark, 200)
    src = str(tmp_path / "src")
    ticks.write.parquet(src)
    ticks.write.mode("append").parquet(src)
    stream = files.stream_ticks(spark, src, files_per_trigger=1)
    unique = sinks.drain_append(tick_streams.dedupe_stream(stream, ["tick_id"], "1 day"), "unique")
    assert same(unique, ticks)
    once = str(tmp_path / "once")
    ticks.repartitionByRange(3, "ts").write.parquet(once)
    live = tick_streams.bars_stream(files.stream_ticks(spark, once, files_per_trigger=1), "H1", "1 day")
    assert same(sinks.drain_updates(live, ["symbol", "tf", "bar_ts"], "live"), bar_ops.to_bars(ticks, "H1"))


def test_order_life_in_one_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    # The last row only moves the clock past the others.
    log_df(spark, [*LOG, (99, at(3010) + dt.timedelta(seconds=1), "PLACE")]).write.parquet(src)
    stream = files.stream_table(spark, src, schemas.ORDER_EVENTS)
    got = sinks.drain_append(order_streams.order_fsm(stream, 86400, "10 minutes"), "lives").collect()
    ended = {e for e in ENDS if e[2] != "PENDING"}
    assert {(r.order_id, r.placed, r.state) for r in got} == ended


def jittered(df, ts, n, path):
    """Land the rows in n files by time, some of them one file late or early, one at a time."""
    rows = sorted(df.collect(), key=lambda r: r[ts] + dt.timedelta(minutes=(hash(r[0]) % 3) * 4))
    size = -(-len(rows) // n)
    for i in range(n):
        spark = df.sparkSession
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
        yield


def test_order_life_over_batches(spark, tmp_path):
    """Rows out of order across files, a restart after each."""
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    rng = np.random.default_rng(8)
    kinds = ["PLACE", "FILL", "CANCEL", "REJECT", "QUOTE"]
    rows = [(int(rng.integers(0, 25)), at(float(m)), str(rng.choice(kinds))) for m in np.sort(rng.random(900) * 20000)]
    log = log_df(spark, rows)
    for _ in jittered(log, "ts", 4, src):
        stream = files.stream_table(spark, src, schemas.ORDER_EVENTS)
        drain(order_streams.order_fsm(stream, 86400, "10 minutes"), path)
    clock = log.filter("kind <> 'QUOTE'").agg(F.date_trunc("millisecond", F.max("ts")).cast("timestamp_ntz")).scalar()
    clock = clock - F.expr("interval 10 minutes")
    due = log.filter(F.col("ts") < log.filter("kind <> 'QUOTE'").agg(F.max("ts") - F.expr("interval 10 minutes")).scalar())
    twin = risk.order_states(due, "1 day", clock).filter("state <> 'PENDING'")
    assert same(spark.read.parquet(f"{path}/out"), twin)


def test_a_late_batch_does_not_change_an_order(spark, tmp_path):
    """A FILL one batch before its earlier PLACE: the order is filled."""
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    parts = [[(1, at(5), "FILL"), (2, at(6), "PLACE")], [(1, at(1), "PLACE")], [(2, at(60), "CANCEL")], [(3, at(99), "PLACE")]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(10 * i + k, *r) for k, r in enumerate(part)], schemas.ORDER_EVENTS)
        df.coalesce(1).write.mode("append").parquet(src)
        drain(order_streams.order_fsm(files.stream_table(spark, src, schemas.ORDER_EVENTS), 86400, "10 minutes"), path)
    got = spark.read.parquet(f"{path}/out").collect()
    assert {(r.order_id, r.state) for r in got} == {(1, "FILLED"), (2, "CANCELLED")}


def test_gates_equal_the_batch(spark, tmp_path):
    rows = [dict(r, spread=None) if r["trade_id"] % 41 == 0 else r for r in offers(400)]
    df = offers_df(spark, rows)
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    for _ in jittered(df, "open_ts", 3, src):
        stream = files.stream_table(spark, src, df.schema)
        drain(order_streams.risk_gate_stream(stream, 0.8, 2, 60.0, "10 minutes"), path)
    newest = df.agg(F.max("open_ts") - F.expr("interval 10 minutes")).scalar()
    twin = risk.risk_gate(df, 0.8, 2, 60.0).filter(F.col("open_ts") < newest)
    twin = twin.select("account_id", "trade_id", "open_ts", "decision", "reason")
    assert twin.count() > 350 and same(spark.read.parquet(f"{path}/out"), twin)


class States:
    """State and timers of one key, held here; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.values = 0, set(), {}, {}

    def getMapState(self, name, *_):
        return self._state(self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return self._state(self.values.setdefault(name, {}))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def _state(self, kept):
        from types import SimpleNamespace

        def counted(call):
            def run(*args):
                self.calls += 1
                return call(*args)

            return run

        calls = {
            "getValue": kept.get, "updateValue": kept.__setitem__, "removeKey": kept.pop, "keys": lambda: iter(list(kept)),
            "exists": lambda: bool(kept), "get": lambda: kept[0], "update": lambda v: kept.__setitem__(0, v), "clear": kept.clear,
        }
        return SimpleNamespace(**{name: counted(call) for name, call in calls.items()})


def clock_at(ms):
    from types import SimpleNamespace

    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_state_calls_do_not_grow_with_the_orders():
    def calls(orders):
        states, life = States(), order_streams.OrderLife(3_600_000_000, "PLACE", {"FILL": "FILLED"})
        life.init(states)
        ids = np.arange(orders)
        us = np.concatenate([ids + 1_000_000, ids + 2_000_000])
        frame = {"order_id": np.tile(ids, 2), "event_id": np.arange(2 * orders), "ts": us.astype("datetime64[us]")}
        frame = pd.DataFrame(frame | {"kind": ["PLACE"] * orders + ["FILL"] * orders})
        assert list(life.handleInputRows((0,), iter([frame]), clock_at(0))) == []
        got = pd.concat(life.handleExpiredTimer((0,), clock_at(60_000), None))
        assert sorted(got["order_id"]) == list(range(orders)) and set(got["state"]) == {"FILLED"}
        return states.calls

    assert calls(500) == calls(5)


def test_due_rows_come_by_slots_of_time():
    """Three hours of proposals become due at once, and are decided an hour at a time."""
    states, ledger = States(), order_streams.RiskLedger(2, 40.0)
    ledger.init(states)
    us = np.arange(180)[::-1] * 60_000_000
    frame = pd.DataFrame({"trade_id": np.arange(180), "open_ts": us.astype("datetime64[us]"), "sound": True, "pnl": 1.0})
    frame["close_ts"] = frame["open_ts"] + pd.Timedelta(seconds=30)
    for part in (frame[:50], frame[50:]):
        assert list(ledger.handleInputRows((7,), iter([part]), clock_at(0))) == []
    out = list(ledger.handleExpiredTimer((7,), clock_at(10_000_000), None))
    assert [len(part) for part in out] == [60, 60, 47]
    got = pd.concat(out)
    assert got["trade_id"].tolist() == list(range(179, 12, -1)) and set(got["decision"]) == {"ACCEPT"}


def test_live_features_equal_the_batch(spark, tmp_path):
    df = bars_df(spark, bars_pdf(90))
    wanted = [ft.true_range(), ft.bb_width(), ft.ema(n=3)]
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    edges = [at(0), at(60 * 20), at(60 * 21), at(60 * 90)]
    for lo, hi in zip(edges, edges[1:]):
        inside = (F.col("bar_ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("bar_ts") < F.lit(hi).cast("timestamp_ntz"))
        df.filter(inside).write.mode("append").parquet(src)
        stream = files.stream_table(spark, src, schemas.BARS)
        tick_streams.features_stream(stream, f"{path}/tail", f"{path}/out", f"{path}/cp", wanted).awaitTermination()
    got = spark.read.parquet(f"{path}/out").toPandas().sort_values(["symbol", "bar_ts"])
    want = ft.compute(df, *wanted).toPandas().sort_values(["symbol", "bar_ts"])
    assert len(got) == 180
    for c in ("tr", "bb_width", "ema"):
        assert np.allclose(got[c], want[c]), c


def test_fills(spark, tmp_path):
    ticks, orders = str(tmp_path / "bars"), str(tmp_path / "orders")
    bars_df(spark, bars_pdf(48, symbols=("A",), tf="M5", hours=1 / 12)).write.parquet(ticks)
    rows = [(1, "A", at(7), 1e9), (2, "A", at(7), -1e9), (3, "B", at(7), 1e9)]
    spark.createDataFrame(rows, "order_id long, symbol string, ts timestamp_ntz, entry double").write.parquet(orders)
    live = files.stream_table(spark, ticks, schemas.BARS)
    placed = files.stream_table(spark, orders, spark.read.parquet(orders).schema)
    fills = sinks.drain_append(tick_streams.fills_stream(placed, live, 3600, "10 minutes"), "fills")
    assert fills.count() == 12  # one row per bar of the hour
    first = tick_streams.first_fill(fills).collect()
    assert [(r.order_id, r.fill_ts) for r in first] == [(1, at(10))]


def test_first_fills_over_restarts(spark, tmp_path):
    """Each run reads one more file, the bars' files in the wrong order within the lateness."""
    path = str(tmp_path)
    rows = [(i, "A", at(5 * i + 2), 1e9 if i % 3 else -1e9) for i in range(60)]
    orders = spark.createDataFrame(rows, "order_id long, symbol string, ts timestamp_ntz, entry double")
    made = bars_df(spark, bars_pdf(72, symbols=("A",), tf="M5", hours=1 / 12))
    late = made.withColumn("land", F.col("bar_ts") + F.make_dt_interval(mins=F.when(F.minute("bar_ts") % 10 == 0, 7).otherwise(0)))
    schema = orders.schema
    for i, (lo, hi) in enumerate([(-60, 90), (90, 200), (200, 900)]):
        def inside(c, lo=lo, hi=hi):
            return (F.col(c) >= F.lit(at(lo)).cast("timestamp_ntz")) & (F.col(c) < F.lit(at(hi)).cast("timestamp_ntz"))

        orders.filter(inside("ts")).write.mode("append").parquet(f"{path}/orders")
        late.filter(inside("land")).drop("land").write.mode("append").parquet(f"{path}/bars")
        fills = tick_streams.first_fills_stream(
            files.stream_table(spark, f"{path}/orders", schema), files.stream_table(spark, f"{path}/bars", schemas.BARS), 3600, "10 minutes"
        )
        drain(fills, path)
    got = sorted((r.order_id, r.fill_ts) for r in spark.read.parquet(f"{path}/out").collect())
    clock = min(5 * 59 + 2, 5 * 71) - 10 - 60  # what may still be filled earlier waits
    assert got == [(i, at(5 * i + 5)) for i in range(60) if i % 3 and 5 * i + 2 <= clock]


def test_audit_log_appends(spark, tmp_path):
    path, src = str(tmp_path / "audit"), str(tmp_path / "src")
    rows = risk.audit_rows(risk.risk_gate(offers_df(spark, offers(20)), 0.8, 2, 60.0))
    files.write_audit(rows, path)
    files.write_audit(rows, path)
    assert spark.read.parquet(path).count() == 40
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        stream = files.stream_table(spark, src, schemas.AUDIT)
        files.write_audit(stream, f"{path}-live", f"{path}-cp").awaitTermination()
    assert spark.read.parquet(f"{path}-live").count() == 20


def test_models(spark):
    table = models.training_table(bars_df(spark, bars_pdf(260))).cache()
    assert table.count() > 300
    scored = models.apply_direction(models.fit_direction(table), table)
    row = scored.agg(F.min("p_bull").alias("lo"), F.max("p_bull").alias("hi"), F.min("confidence").alias("c")).first()
    assert 0 <= row.lo < row.hi <= 1 and row.c >= 0.5
    model = models.fit_gbt(table, F.lit(at(60 * 200)).cast("timestamp_ntz"), rounds=3)
    assert models.apply_direction(model, table).count() == table.count()
    rows = models.scoring_table(bars_df(spark, bars_pdf(260)))
    newest = rows.groupBy("symbol").agg(F.max("bar_ts")).collect()
    assert {r[1] for r in newest} == {at(60 * 259)}  # the bar that a user wants scored
    uri = models.save(model, fresh_dir(spark, "model"))
    assert same(models.score(rows, uri), models.apply_direction(model, rows))


def test_trees_from_their_file(spark, tmp_path):
    table = models.training_table(bars_df(spark, bars_pdf(260))).cache()
    model = models.fit_gbt(table, F.lit(at(60 * 200)).cast("timestamp_ntz"))
    uri, marks = models.save_trees(spark, model, fresh_dir(spark, "trees")), str(tmp_path)

    def load(data):
        import os
        import uuid

        open(f"{marks}/{os.getpid()}-{uuid.uuid4()}", "w").close()
        return models.load_trees(data)

    rows = models.apply_direction(model, table).repartition(16)
    for _ in range(2):
        scored = models.score_file(rows, uri, load, models.predict_trees, models.INPUTS, "p_file")
        assert scored.columns == [*rows.columns, "p_file"] and scored.count() == table.count()
        assert scored.agg(F.max(F.abs(F.col("p_file") - F.col("p_bull")))).first()[0] <= 1e-9
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))  # once per worker process, in both jobs together
    assert models.score_file(rows.limit(0), uri, load, models.predict_trees, models.INPUTS).count() == 0
    two = fresh_dir(spark, "two-files")
    spark.range(2).selectExpr("string(id)").repartition(2).write.text(two)
    with pytest.raises(ValueError):
        models.score_file(rows, two, load, models.predict_trees, models.INPUTS)


def test_saved_weights(spark):
    x = spark.createDataFrame([([1.0, 3.0, 2.0],), ([4.0, 4.0, 4.0],)], "x array<double>")
    uri = models.save_weights(spark, [0.5, 1.0], fresh_dir(spark, "weights"))
    got = [r.score for r in models.score_samples(x, uri, "x").collect()]
    assert got == [pytest.approx(1 / (1 + np.exp(-(0.5 * -0.5 + 1.0 * 0.5)))), 0.5]
