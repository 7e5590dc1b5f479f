from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from frames import T0, at, ticks_df
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import joins, metrics, risk, validation
from barloom.sources import files

DAY = dt.timedelta(days=1)


def trades_df(spark, pnls, strategy=1, minutes=10):
    rows = [
        (i, 1, strategy, "A", at(minutes * i), at(minutes * i + 5), float(p)) for i, p in enumerate(pnls)
    ]
    return spark.createDataFrame(rows, schemas.TRADES)


def brute_drawdown(pnls):
    eq = np.cumsum(pnls)
    return float((np.maximum.accumulate(np.r_[0, eq])[1:] - eq).max())


@pytest.mark.parametrize("pnls", [[1, 2, 3], [-1, -2], [-5, 3, 9, -4, -4, 6], [2.5]], ids=["wins", "losses", "mixed", "one"])
def test_ledger(spark, pnls):
    df = trades_df(spark, pnls)
    assert metrics.max_drawdown(df, ["strategy_id"]).first().max_drawdown == pytest.approx(brute_drawdown(pnls))
    stats = metrics.trade_stats(df, ["strategy_id"]).first()
    loss = -sum(p for p in pnls if p < 0)
    want = sum(p for p in pnls if p > 0) / loss if loss else None
    assert stats.profit_factor == (pytest.approx(want) if loss else None)


def test_drawdown_over_many_stretches(spark):
    pnls = np.random.default_rng(2).normal(0, 10, 400).round(2)
    for grain in (60, 7200, 10**7):
        got = metrics.max_drawdown(trades_df(spark, pnls), ["strategy_id"], grain).first().max_drawdown
        assert got == pytest.approx(brute_drawdown(pnls))


def test_deflated_sharpe_by_hand(spark):
    rng = np.random.default_rng(4)
    series = {k: rng.normal(0.1 * k, 1, 300) for k in (1, 2, 3)}
    df = trades_df(spark, series[1], 1)
    for k in (2, 3):
        df = df.unionByName(trades_df(spark, series[k], k))
    got = {r.strategy_id: r.dsr for r in metrics.deflated_sharpe(df, ["strategy_id"]).collect()}
    n = NormalDist()
    sharpe = {k: x.mean() / x.std(ddof=1) for k, x in series.items()}
    g, e, trials = 0.5772156649015329, np.e, 3
    best = np.std(list(sharpe.values()), ddof=1) * (
        (1 - g) * n.inv_cdf(1 - 1 / trials) + g * n.inv_cdf(1 - 1 / (trials * e))
    )
    for k, x in series.items():
        z = (x - x.mean()) / x.std()
        skew, kurt, sr = (z**3).mean(), (z**4).mean(), sharpe[k]
        want = n.cdf((sr - best) * np.sqrt(299) / np.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2))
        assert got[k] == pytest.approx(want)


def test_gates_reject_a_lucky_strategy(spark):
    rng = np.random.default_rng(9)
    df = trades_df(spark, rng.normal(1.0, 1, 300), 0)  # a real edge
    for k in range(1, 8):
        df = df.unionByName(trades_df(spark, rng.normal(0, 1, 300), k))
    rules = validation.default_gates(min_factor=1.0, min_win=0.4, max_fall=1000.0)
    got = {r.strategy_id: r for r in validation.gates(metrics.proof_report(df, ["strategy_id"]), rules).collect()}
    assert got[0].passed and got[0].reasons == []
    assert all(not got[k].passed and "dsr" in got[k].reasons for k in range(1, 8))


def test_monte_carlo_by_brute_force(spark):
    from hashlib import md5

    pnls = np.random.default_rng(6).normal(0, 5, 30).round(2)
    blocks = validation.trade_blocks(trades_df(spark, pnls), ["strategy_id"])
    got = validation.mc_drawdown(blocks, ["strategy_id"], runs=20, seed=3, stretch=7)
    rows = {r.run: r.max_drawdown for r in got.collect()}
    assert len(rows) == 20
    for run in rows:
        picks = [int(md5(f"3|{run}|1|{p}".encode()).hexdigest()[:15], 16) % 30 for p in range(30)]
        assert rows[run] == pytest.approx(brute_drawdown(pnls[picks]))


@pytest.mark.parametrize("length,n", [(1, 30), (7, 30), (8, 9), (25, 5)])
def test_moving_blocks_by_brute_force(spark, length, n):
    from hashlib import md5

    pnls = np.random.default_rng(length).normal(0, 5, n).round(2)
    blocks = validation.moving_blocks(trades_df(spark, pnls), ["strategy_id"], length)
    starts = max(n - length + 1, 1)
    assert sorted(r.block_no for r in blocks.collect()) == list(range(starts))
    got = validation.mc_drawdown(blocks, ["strategy_id"], runs=12, seed=3, stretch=2, length=length)
    rows = {r.run: (r.profit, r.max_drawdown) for r in got.collect()}
    assert len(rows) == 12
    for run, (profit, drawdown) in rows.items():
        draws = -(-(starts + length - 1) // length)
        picks = [int(md5(f"3|{run}|1|{p}".encode()).hexdigest()[:15], 16) % starts for p in range(draws)]
        drawn = np.concatenate([pnls[p : p + length] for p in picks])
        assert (profit, drawdown) == (pytest.approx(drawn.sum()), pytest.approx(brute_drawdown(drawn)))


@pytest.mark.parametrize("embargo,trains", [(0, {0, 1}), (2, {0})])
def test_fold_edges(spark, embargo, trains):
    start = T0 + dt.timedelta(hours=10)
    rows = [
        (0, start - dt.timedelta(hours=9), start - dt.timedelta(hours=4)),
        (1, start - dt.timedelta(hours=6), start - dt.timedelta(hours=1)),
        (2, start - dt.timedelta(hours=5), start),  # the label ends as the test starts
        (3, start - dt.timedelta(hours=4), start + dt.timedelta(hours=1)),
        (4, start, start + dt.timedelta(hours=5)),
        (5, start + dt.timedelta(hours=2), start + dt.timedelta(hours=7)),
    ]
    df = spark.createDataFrame(rows, "id int, bar_ts timestamp_ntz, label_end timestamp_ntz")
    fold = [(1, start, start + dt.timedelta(hours=2))]
    got = validation.purged_folds(df, fold, dt.timedelta(hours=embargo)).collect()
    assert {r.id for r in got if r.role == "train"} == trains
    assert {r.id for r in got if r.role == "test"} == {4}


def test_walk_forward_trains_on_the_past_only(spark):
    df = spark.createDataFrame(
        [(i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 2)) for i in range(50)],
        "id int, bar_ts timestamp_ntz, label_end timestamp_ntz",
    )
    folds = validation.equal_folds(T0, T0 + dt.timedelta(hours=50), 4)

    def fit(train):
        newest = train.agg(F.max("label_end")).first()[0]
        return lambda test: test.withColumn("trained_to", F.lit(newest).cast("timestamp_ntz"))

    got = validation.walk_forward(df, folds, dt.timedelta(hours=1), fit).toPandas()
    assert (got["trained_to"] < got["bar_ts"] - pd.Timedelta(hours=1)).all()
    assert sorted(got["fold"].unique()) == [1, 2, 3, 4] and len(got) == 40


def test_shuffled_outcomes_fall_to_chance(spark):
    rng = np.random.default_rng(1)
    outcome = rng.random(600) < 0.5
    predicted = np.where(rng.random(600) < 0.9, outcome, ~outcome)
    rows = [("A" if i % 3 else "B", at(i), bool(p), bool(o)) for i, (p, o) in enumerate(zip(predicted, outcome))]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, predicted boolean, outcome boolean")
    got = validation.permutation_test(df, runs=10, seed=5).toPandas().set_index("run")
    assert (got["n"] == 600).all()
    assert got.loc[0, "hit_rate"] > 0.85
    assert abs(got.drop(0)["hit_rate"].mean() - 0.5) < 0.03


def test_friction(spark):
    ticks = ticks_df(spark, [(1, "A", at(0), 10.0, 0.2), (2, "A", at(0) + dt.timedelta(milliseconds=100), 11.0, 0.4),
                             (3, "A", at(5), 14.0, 0.1)])
    trades = spark.createDataFrame(
        [(1, 7, "A", "BUY", at(0), at(5)), (2, 7, "A", "SELL", at(0), at(5))],
        "trade_id long, strategy_id long, symbol string, side string, open_ts timestamp_ntz, close_ts timestamp_ntz",
    )
    got = validation.friction_shock(trades, ticks, [("base", 1.0, 0), ("both", 3.0, 150)]).collect()
    pnl = {(r.scenario, r.trade_id): r.pnl for r in got}
    assert pnl["base", 1] == pytest.approx(4 - 0.2) and pnl["base", 2] == pytest.approx(-4 - 0.2)
    assert pnl["both", 1] == pytest.approx(3 - 1.2) and pnl["both", 2] == pytest.approx(-3 - 1.2)
    early = trades.withColumn("open_ts", F.col("open_ts") - F.expr("interval 1 day"))
    late = validation.friction_shock(early, ticks, [("base", 1.0, 0)]).collect()
    assert {(r.pnl, r.status) for r in late} == {(None, "NO_QUOTE")}


def log_df(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.ORDER_EVENTS)


LOG = [
    (1, at(0), "PLACE"), (1, at(5), "PLACE"), (1, at(9), "FILL"), (1, at(10), "CANCEL"),
    (2, at(0), "FILL"), (2, at(1), "PLACE"), (2, at(2), "CANCEL"), (2, at(3), "PLACE"), (2, at(4), "REJECT"),
    (3, at(0), "PLACE"), (3, at(1441), "FILL"),  # a minute too late
    (4, at(0), "PLACE"), (4, at(2000), "PLACE"), (4, at(2001), "FILL"),
    (5, at(2500), "PLACE"),
    (6, at(0), "PLACE"),
    (7, at(0), "PLACE"), (7, at(1440), "FILL"),  # exactly at the deadline
    (8, at(0), "QUOTE"),
]
ENDS = {
    (1, at(0), "FILLED"), (2, at(1), "CANCELLED"), (2, at(3), "REJECTED"), (3, at(0), "EXPIRED"),
    (4, at(0), "EXPIRED"), (4, at(2000), "FILLED"), (5, at(2500), "PENDING"), (6, at(0), "EXPIRED"),
    (7, at(0), "FILLED"),
}


def test_order_log(spark):
    got = risk.order_states(log_df(spark, LOG), "1 day", F.lit(at(3000)).cast("timestamp_ntz")).collect()
    assert {(r.order_id, r.placed, r.state) for r in got} == ENDS and len(got) == len(ENDS)
    assert {r.ended for r in got if r.order_id == 6} == {at(1440)}


def test_known_end_states(spark):
    from barloom.sources import views

    log = views.order_events(spark, "/root/testdata/sf0.01")
    got = risk.order_states(log, "1 day", log.agg(F.max("ts")).scalar()).groupBy("state").count()
    counts = {r.state: r["count"] for r in got.collect()}
    assert (counts["CANCELLED"], counts["FILLED"], counts["REJECTED"]) == (397, 395, 383)


def brute_gate(rows, max_spread, max_open, loss):
    """Places and open trades carry over midnight; only the booked sum starts anew."""
    out, day = {}, None
    for _, g in pd.DataFrame(rows).groupby("account_id"):
        booked, held, day = 0.0, [], None
        for r in g.sort_values(["open_ts", "trade_id"]).itertuples():
            if r.day != day:
                day, booked = r.day, 0.0
            minute = r.open_ts.replace(second=0, microsecond=0)
            booked += sum(p for c, p in held if c < minute and c.date() == day)
            held = [(c, p) for c, p in held if c >= minute]
            if not r.spread <= max_spread:
                out[r.trade_id] = "SPREAD"
            elif booked <= -loss:
                out[r.trade_id] = "DAILY_LOSS"
            elif len(held) >= max_open:
                out[r.trade_id] = "MAX_OPEN"
            else:
                out[r.trade_id] = "ACCEPT"
                held.append((r.close_ts, r.pnl))
    return out


def offers(n=600, seed=0, span=2 * 86400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # Half of the offers crowd into a few minutes.
        secs = float(rng.integers(0, span)) if i % 2 else 40_000 + float(rng.random() * 600)
        o = T0 + dt.timedelta(seconds=secs)
        rows.append(
            dict(
                trade_id=i, account_id=int(rng.integers(0, 2)), open_ts=o,
                close_ts=o + dt.timedelta(minutes=float(rng.integers(0, 90))),
                spread=float(rng.random()), pnl=float(rng.normal(0, 20)), day=o.date(),
            )
        )
    return rows


def offers_df(spark, rows):
    return spark.createDataFrame(
        [(r["trade_id"], r["account_id"], r["open_ts"], r["close_ts"], r["spread"], r["pnl"]) for r in rows],
        "trade_id long, account_id long, open_ts timestamp_ntz, close_ts timestamp_ntz, spread double, pnl double",
    )


@pytest.mark.parametrize("max_open,loss", [(1, 30.0), (3, 60.0)])
def test_gate_by_brute_force(spark, max_open, loss):
    rows = offers()
    got = risk.risk_gate(offers_df(spark, rows), 0.8, max_open, loss).collect()
    want = brute_gate(rows, 0.8, max_open, loss)
    assert {r.trade_id: r.reason for r in got} == want
    assert set(want.values()) == {"ACCEPT", "SPREAD", "DAILY_LOSS", "MAX_OPEN"}


def test_gate_feedback(spark):
    """The third trade passes only since the second, which would have lost, was rejected."""
    rows = [
        dict(trade_id=1, account_id=1, open_ts=at(0), close_ts=at(10), spread=0.1, pnl=1.0, day=T0.date()),
        dict(trade_id=2, account_id=1, open_ts=at(5), close_ts=at(12), spread=0.1, pnl=-99.0, day=T0.date()),
        dict(trade_id=3, account_id=1, open_ts=at(20), close_ts=at(25), spread=0.1, pnl=1.0, day=T0.date()),
    ]
    got = risk.risk_gate(offers_df(spark, rows), 1.0, 1, 50.0).collect()
    assert {r.trade_id: r.reason for r in got} == {1: "ACCEPT", 2: "MAX_OPEN", 3: "ACCEPT"}


def test_gate_remembers_the_night(spark):
    rows = [
        dict(trade_id=1, account_id=1, open_ts=at(23 * 60 + 50), close_ts=at(24 * 60 + 20), spread=0.1, pnl=-100.0),
        dict(trade_id=2, account_id=1, open_ts=at(24 * 60 + 5), close_ts=at(24 * 60 + 6), spread=0.1, pnl=1.0),
        dict(trade_id=3, account_id=1, open_ts=at(24 * 60 + 35), close_ts=at(24 * 60 + 36), spread=0.1, pnl=1.0),
        dict(trade_id=4, account_id=1, open_ts=at(49 * 60), close_ts=None, spread=0.1, pnl=None),
        dict(trade_id=5, account_id=1, open_ts=at(90 * 60), close_ts=at(91 * 60), spread=0.1, pnl=1.0),
        dict(trade_id=6, account_id=2, open_ts=at(10), close_ts=at(20), spread=None, pnl=1.0),
        dict(trade_id=7, account_id=2, open_ts=at(11), close_ts=at(20), spread=float("nan"), pnl=1.0),
        dict(trade_id=8, account_id=None, open_ts=at(11), close_ts=at(20), spread=0.1, pnl=1.0),
        dict(trade_id=9, account_id=2, open_ts=None, close_ts=at(20), spread=0.1, pnl=1.0),
    ]
    got = risk.risk_gate(offers_df(spark, rows), 1.0, 1, 5.0).collect()
    assert {r.trade_id: r.reason for r in got} == {
        1: "ACCEPT", 2: "MAX_OPEN", 3: "DAILY_LOSS", 4: "ACCEPT", 5: "MAX_OPEN", 6: "SPREAD", 7: "SPREAD", 8: "KEY", 9: "KEY",
    }


def test_gate_of_trades_that_never_close(spark):
    """A third stays open for ever, others for days."""
    rows = offers(900, seed=3, span=30 * 86400)
    for r in rows:
        if r["trade_id"] % 3 == 0:
            r["close_ts"] = None
        elif r["trade_id"] % 7 == 0:
            r["close_ts"] += dt.timedelta(days=3)
    got = risk.risk_gate(offers_df(spark, rows), 0.8, 60, 15.0).collect()
    far = dt.datetime(9999, 12, 31)
    want = brute_gate([{**r, "close_ts": r["close_ts"] or far} for r in rows], 0.8, 60, 15.0)
    assert {r.trade_id: r.reason for r in got} == want
    assert set(want.values()) == {"ACCEPT", "SPREAD", "DAILY_LOSS", "MAX_OPEN"}


def test_open_count(spark):
    rows = [(1, at(0), at(10)), (2, at(5), at(5)), (3, at(10), at(20)), (4, at(12), at(13))]
    df = spark.createDataFrame(
        [(i, 1, 1, "A", o, c, 0.0) for i, o, c in rows], schemas.TRADES
    )
    got = {r.trade_id: r.open_trades for r in risk.open_count(df, ["account_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}


def test_floating_equity_and_liquidation(spark):
    ticks = ticks_df(spark, [(1, "A", at(0), 9.0, 0.2), (2, "A", at(1), 10.0, 0.4)])
    pos = spark.createDataFrame(
        [(1, 7, "A", "BUY", 2.0, 9.0), (2, 7, "A", "SELL", 1.0, 9.0), (3, 8, "B", "BUY", 1.0, 9.0)], schemas.POSITIONS
    )
    valued = joins.floating_pnl(pos, joins.quotes(ticks))
    assert {r.ticket: r.floating_pnl for r in valued.collect()} == {1: pytest.approx(1.6), 2: pytest.approx(-1.2), 3: None}
    accounts = spark.createDataFrame([(7, 100.0), (8, 50.0), (9, 10.0)], schemas.ACCOUNTS)
    assert {r.account_id: r.equity for r in joins.equity(accounts, valued).collect()} == {
        7: pytest.approx(100.4), 8: None, 9: 10.0,
    }
    pending = log_df(spark, [(1, at(0), "PLACE")])
    rows = risk.liquidation_set(valued, pending).collect()
    assert sorted((r.action, r.id, r.side) for r in rows if r.action == "CLOSE") == [
        ("CLOSE", 1, "SELL"), ("CLOSE", 2, "BUY"), ("CLOSE", 3, "SELL"),
    ]
    assert [r.id for r in rows if r.action == "CANCEL"] == [0]


def test_metadata_and_diff(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "k int, v double")
    stats = metrics.feature_stats(df, ["v"])
    files.write_metadata(stats, str(tmp_path / "meta"))
    back = spark.read.json(str(tmp_path / "meta")).first()
    assert (back.feature, back.idx, back.dtype, back["mean"], back.n) == ("v", 0, "double", 2.0, 2)
    other = spark.createDataFrame([(1, 1.000001), (2, 3.1), (4, 0.0)], "k int, v double")
    got = {r.k: r.state for r in joins.diff_within(df, other, ["k"], ["v"], 1e-5).collect()}
    assert got == {2: "differs", 3: "only_a", 4: "only_b"}


def test_monte_carlo_shuffles_no_draws(spark, monkeypatch):
    from hashlib import md5

    from barloom.operators import draws

    for name, value in (("HELD", 16), ("LEAST", 1), ("SLICE", 4)):
        monkeypatch.setattr(draws, name, value)
    pnls = [None if i % 5 == 0 else float(i * 7 % 11 - 5) for i in range(23)]
    kinds = "strategy_id bigint, block_no bigint, total double, top double, fall double, drop double"
    deep = [(1, i, p, max(p or 0.0, 0.0), min(p or 0.0, 0.0) - i % 2, max(-(p or 0.0), 0.0) + i % 2) for i, p in enumerate(pnls)]
    blocks = spark.createDataFrame(deep + [(2, 0, None, 0.0, 0.0, 0.0), (None, 0, 1.0, 1.0, 0.0, 0.0)], kinds)
    got = validation.mc_drawdown(blocks, ["strategy_id"], runs=9, seed=3, stretch=5)
    plan = got._jdf.queryExecution().toString()
    assert "_pos" not in plan and "block_no" not in plan  # a row for each draw would join by them
    rows = {(r.strategy_id, r.run): (r.profit, r.max_drawdown) for r in got.collect()}
    assert len(rows) == 18 and all(rows[2, run] == (None, 0.0) for run in range(1, 10))
    for run in range(1, 10):
        at = peak = worst = 0.0
        for p in range(23):
            _, _, total, top, fall, drop = deep[int(md5(f"3|{run}|1|{p}".encode()).hexdigest()[:15], 16) % 23]
            worst = max(worst, drop, peak - (at + fall))
            peak, at = max(peak, at + top), at + (total or 0.0)
        assert rows[1, run] == (at, worst)


def broadcast_rows(plan):
    """Rows of every broadcast in a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return broadcast_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in broadcast_rows(below.apply(i))]


def test_monte_carlo_sends_no_draws_through_the_driver(spark):
    kinds = "strategy_id bigint, block_no bigint, total double, top double, fall double, drop double"
    rows = [(k, i, 1.0, 1.0, 0.0, 0.0) for k in (1, 2) for i in range(300)]
    blocks = spark.createDataFrame(rows, kinds)
    most = []
    for runs in (10, 100):
        got = validation.mc_drawdown(blocks, ["strategy_id"], runs=runs, seed=3)
        assert {tuple(r) for r in got.collect()} == {(k, run, 300.0, 0.0) for k in (1, 2) for run in range(1, runs + 1)}
        most.append(max(broadcast_rows(got._jdf.queryExecution().executedPlan()), default=0))
    assert max(most) <= 64, most  # not a row for each of up to 60,000 draws


def test_monte_carlo_shuffles_no_copies_of_blocks(spark, monkeypatch):
    from barloom.operators import draws

    for name, value in (("HELD", 16), ("LEAST", 1), ("SLICE", 4)):
        monkeypatch.setattr(draws, name, value)
    kinds = "strategy_id bigint, block_no bigint, total double, top double, fall double, drop double"
    blocks = spark.createDataFrame([(1, i, -1.0, 0.0, -1.0, 1.0) for i in range(23)], kinds)
    got = validation.mc_drawdown(blocks, ["strategy_id"], runs=9, seed=3, stretch=5)
    assert {tuple(r) for r in got.collect()} == {(1, run, -23.0, 23.0) for run in range(1, 10)}
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "CartesianProduct" in plan and "REPARTITION_BY_NUM" in plan
    assert all("total" not in line or "run" in line for line in plan.split("\n") if "Exchange" in line)


def test_held_draws_need_every_block():
    import pyarrow as pa

    from barloom.operators.draws import PARTS, Held

    def held():
        return Held(seed=3, mid="|1|", n=6, draws=8, stretch=3, lo=0, hi=5)

    def part(values):
        return {"total": pa.array(values)} | dict.fromkeys(PARTS[1:])

    there, back = held(), held()
    there.fill(0, part([1.0, -2.0, 3.0, -4.0])), there.fill(4, part([5.0, -6.0]))
    back.fill(4, part([5.0, -6.0])), back.fill(0, part([1.0, -2.0, 3.0, -4.0]))
    assert there.summaries() == back.summaries()
    few = held()
    few.fill(0, part([1.0, -2.0, 3.0, -4.0]))
    with pytest.raises(ValueError, match="4 of 6 blocks"):
        few.summaries()


def test_hashed_draws_equal_md5():
    from hashlib import md5

    from barloom.operators.draws import md5_60

    for head, first, n in ((b"11|7|2|", 0, 1200), (b"", 98, 5), ("é|".encode() * 16, 7, 9), (b"x" * 54, 8, 5), (b"x" * 90, 8, 5)):
        want = [int(md5(head + b"%d" % i).hexdigest()[:15], 16) for i in range(first, first + n)]
        assert md5_60(head, first, n).tolist() == want
