"""Forecast scores, orders, risk, validation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import joins, labels, metrics, policy, risk, samples, tiles, validation
from barloom.plans.feature_queries import ATR14, OVER, forecasts_sql
from barloom.plans.oracle import (
    ORDER_EVENTS, POSITIONS, TICKS, TRADES, bars, r, with_averages,
)
from barloom.plans.registry import query
from barloom.sources import views

KEY = ["symbol", "bar_ts"]


def _with_atr(spark, sf):
    return ft.compute(views.bars(spark, sf), ft.atr())


def _proposals(spark, sf):
    return policy.propose(samples.quantile_baseline(views.bars(spark, sf)), _with_atr(spark, sf))


# --- trades ---------------------------------------------------------------

STATS = """count(*) as n, round(avg(case when pnl > 0 then 1e0 else 0e0 end), 6) as win_rate,
  round(sum(pnl), 6) + 0e0 as profit, round(sum(case when pnl > 0 then pnl else 0 end) /
  nullif(sum(case when pnl < 0 then -pnl else 0 end), 0), 6) as profit_factor"""


@query("c3_trade_stats", f"with {TRADES} select strategy_id, symbol, {STATS} from trades group by 1, 2")
def c3(spark, sf):
    return metrics.trade_stats(views.trades(spark, sf), ["strategy_id", "symbol"])


DRAWDOWN = """dd as (select strategy_id, max(peak - eq) as max_drawdown from (select *, greatest(0,
  max(eq) over (partition by strategy_id order by close_ts, trade_id)) as peak from (select *,
  sum(pnl) over (partition by strategy_id order by close_ts, trade_id) as eq from trades)) group by 1)"""


@query(
    "c4_max_drawdown",
    f"with {TRADES}, {DRAWDOWN} select strategy_id, {r('max_drawdown')} as max_drawdown from dd",
)
def c4(spark, sf):
    return metrics.max_drawdown(views.trades(spark, sf), ["strategy_id"])


@query(
    "c5_moments",
    f"""with {TRADES}, s as (select strategy_id, count(*) as n, avg(pnl) as mean, stddev_samp(pnl) as std,
  stddev_pop(pnl) as sd from trades group by 1),
  m as (select strategy_id, n, mean, std, sd, avg(power(pnl - mean, 3)) as m3, avg(power(pnl - mean, 4)) as m4
  from trades join s using (strategy_id) group by all)
  select strategy_id, n, {r('mean')} as mean, {r('std')} as std, {r('mean / std')} as sharpe,
  {r('m3 / power(sd, 3)')} as skew, {r('m4 / power(sd, 4)')} as kurt from m""",
)
def c5_moments(spark, sf):
    return metrics.moments(views.trades(spark, sf), ["strategy_id"])


def phi(x: str) -> str:
    """The normal distribution at x, integrated by Simpson's rule over 2,000 strips."""
    weight = "case when i in (0, 2000) then 1e0 when i % 2 = 1 then 4e0 else 2e0 end"
    strips = f"list_sum(list_transform(range(0, 2001), lambda i: {weight} * exp(-power(({x}) * i / 2000e0, 2) / 2)))"
    return f"(0.5e0 + ({x}) * 0.3989422804014327e0 * {strips} / 6000e0)"


# `bl`: bisection for the normal quantiles of the expected maximum; `ds`: the deflated ratio.
DEFLATED = f"""mo as (select strategy_id, count(*) as n, avg(pnl) as mean, stddev_samp(pnl) as std,
  stddev_pop(pnl) as sd from trades group by 1),
  mm as (select strategy_id, n, mean, std, sd, avg(power(pnl - mean, 3)) as m3, avg(power(pnl - mean, 4)) as m4
  from trades join mo using (strategy_id) group by all),
  tr as materialized (select strategy_id, n, mean, std, mean / std as sharpe, m3 / power(sd, 3) as skew,
  m4 / power(sd, 4) as kurt from mm),
  tg as materialized (select count(sharpe) as trials, var_samp(sharpe) as v from tr),
  bl as (select w, case w when 1 then 1 - 1e0 / trials else 1 - 1e0 / (trials * 2.718281828459045e0) end as p,
  -10e0 as lo, 10e0 as hi, 0 as k from tg, (values (1), (2)) x(w) union all
  select w, p, case when {phi('mid')} < p then mid else lo end, case when {phi('mid')} < p then hi else mid end, k + 1
  from (select *, (lo + hi) / 2 as mid from bl where k < 60)),
  qu as (select max((lo + hi) / 2) filter (w = 1) as q1, max((lo + hi) / 2) filter (w = 2) as q2 from bl where k = 60),
  eb as (select trials, sqrt(v) * ((1 - 0.5772156649015329e0) * q1 + 0.5772156649015329e0 * q2) as best from tg, qu),
  dz as (select tr.*, trials, best as expected_best, (sharpe - best) * sqrt(n - 1) /
  nullif(sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe), 0) as z from tr, eb),
  ds as materialized (select *, {phi('z')} as dsr from dz)"""


@query(
    "c5_deflated_sharpe",
    f"""with recursive {TRADES}, {DEFLATED} select strategy_id, n, {r('mean')} as mean, {r('std')} as std,
  {r('sharpe')} as sharpe, {r('skew')} as skew, {r('kurt')} as kurt, trials, {r('expected_best')} as expected_best,
  {r('dsr')} as dsr from ds""",
)
def c5(spark, sf):
    return metrics.deflated_sharpe(views.trades(spark, sf), ["strategy_id"])


@query(
    "c6_proof_report",
    f"""with recursive {TRADES}, {DRAWDOWN}, {DEFLATED}, st as (select strategy_id, {STATS} from trades group by 1)
  select strategy_id, st.n, win_rate, profit, profit_factor, {r('max_drawdown')} as max_drawdown, {r('sharpe')} as sharpe,
  {r('expected_best')} as expected_best, {r('dsr')} as dsr from st join dd using (strategy_id) join ds using (strategy_id)""",
)
def c6(spark, sf):
    return metrics.proof_report(views.trades(spark, sf), ["strategy_id"])


@query(
    "c10_open_count",
    f"""with {TRADES} select t.account_id, t.trade_id, t.open_ts, count(o.trade_id) as open_trades
  from trades t left join trades o on o.account_id = t.account_id and o.open_ts <= t.open_ts
  and o.close_ts > t.open_ts group by 1, 2, 3""",
)
def c10(spark, sf):
    return risk.open_count(views.trades(spark, sf), ["account_id"])


# --- forecasts ------------------------------------------------------------

FORECAST = f"{bars()}, {forecasts_sql()}"


@query(
    "c7_pinball",
    f"""{FORECAST} select symbol, count(*) as n,
  {r('avg(greatest(0.1e0 * (close - q10), -0.9e0 * (close - q10)))')} as loss_q10,
  {r('avg(greatest(0.5e0 * (close - q50), -0.5e0 * (close - q50)))')} as loss_q50,
  {r('avg(greatest(0.9e0 * (close - q90), -0.1e0 * (close - q90)))')} as loss_q90,
  {r('avg(case when close between q10 and q90 then 1e0 else 0e0 end)')} as coverage
  from fc join bars using (symbol, tf, bar_ts) group by 1""",
)
def c7(spark, sf):
    table = views.bars(spark, sf)
    scored = joins.forecast_vs_actual(samples.quantile_baseline(table), table)
    return metrics.pinball(scored, ["symbol"], "close", {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query(
    "c8_direction_metrics",
    f"""{FORECAST}, y as (select fc.*, close > lag_close as up from fc join (select symbol, bar_ts, close,
  lag(close) over (partition by symbol order by bar_ts) as lag_close from bars) using (symbol, bar_ts)),
  c as (select symbol, case when up then 1e0 else 0e0 end as y, up, p_bull,
  greatest(least(p_bull, 1 - 1e-9), 1e-9) as q from y)
  select symbol, count(*) as n, {r('avg(case when (p_bull > 0.5) = up then 1e0 else 0e0 end)')} as accuracy,
  {r('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))')} as log_loss, {r('avg((q - y) * (q - y))')} as brier
  from c group by 1""",
)
def c8(spark, sf):
    table = views.bars(spark, sf)
    fc = samples.quantile_baseline(table)
    # The direction label of a bar sits on the bar before it.
    ups = tiles.tiled(
        tiles.number_bars(table), lambda df, w: df.withColumn("_pc", F.lag("close").over(w)), before=1
    ).select("symbol", "tf", "bar_ts", (F.col("close") > F.col("_pc")).alias("up"))
    return metrics.direction_metrics(fc.join(ups, ["symbol", "tf", "bar_ts"]), ["symbol"], "p_bull", "up")


TRIGGER_FORECAST = f"{bars()}, {forecasts_sql(20)}"


@query(
    "b13_trigger",
    f"""{TRIGGER_FORECAST} select symbol, bar_ts, {r('p_bull')} as p_bull, {r('confidence')} as confidence
  from fc where confidence > 0.7""",
)
def b13(spark, sf):
    fc = samples.quantile_baseline(views.bars(spark, sf), win=20)
    return policy.trigger(fc).select(*KEY, "p_bull", "confidence")


@query("b14_max_spread", f"with {TICKS} select tick_id, symbol, spread from ticks where spread <= 0.25")
def b14(spark, sf):
    return policy.spread_ok(views.ticks(spark, sf), 0.25).select("tick_id", "symbol", "spread")


# --- orders ---------------------------------------------------------------

PROPOSALS = f"""{with_averages(ATR14)}, {forecasts_sql()}, props as materialized (select symbol, tf, bar_ts, side,
  entry, round(entry - way * atr, 5) as sl, round(entry + way * 1.5e0 * atr, 5) as tp, 6 as expiry_bars,
  confidence as p_win, spread as friction, way, rn from (select *, round(close - way * 0.25e0 * atr, 5) as entry
  from (select fc.*, a.close, a.atr, a.spread, a.rn, case when p_bull >= 0.5 then 1e0 else -1e0 end as way,
  case when p_bull >= 0.5 then 'BUY_LIMIT' else 'SELL_LIMIT' end as side from fc join a using (symbol, tf, bar_ts))))"""
ORDER_COLS = f"""symbol, bar_ts, side, {r('entry')} as entry, {r('sl')} as sl, {r('tp')} as tp, expiry_bars,
  {r('p_win')} as p_win, {r('friction')} as friction"""
VALID = """(case when side = 'BUY_LIMIT' then sl < entry and entry < tp else tp < entry and entry < sl end
  and expiry_bars >= 1 and least(sl, entry, tp) > 0)"""
# Prices have five digits and shares two, so values in points of 1e-5 round without ties.
EV = "p_win * abs(tp - entry) - (1 - p_win) * abs(entry - sl) - friction"


@query("e7_propose", f"{PROPOSALS} select {ORDER_COLS} from props")
def e7(spark, sf):
    return _proposals(spark, sf).drop("tf")


@query("b12_valid_order", f"{PROPOSALS} select symbol, bar_ts, side, {VALID} as valid from props")
def b12(spark, sf):
    return _proposals(spark, sf).select(*KEY, "side", labels.valid_order().alias("valid"))


def _points():
    return (F.col("ev") * 1e5).alias("ev_points")


@query("f4_expectancy", f"{PROPOSALS} select symbol, bar_ts, {r(f'({EV}) * 1e5')} as ev_points from props")
def f4(spark, sf):
    return labels.expectancy(_proposals(spark, sf)).select(*KEY, _points())


@query("b15_expectancy_filter", f"{PROPOSALS} select symbol, bar_ts, {r(f'({EV}) * 1e5')} as ev_points from props where {EV} > 0")
def b15(spark, sf):
    return labels.expectancy_filter(_proposals(spark, sf)).select(*KEY, _points())


@query(
    "f6_proposals_end_to_end",
    f"{PROPOSALS} select {ORDER_COLS}, {r(f'({EV}) * 1e5')} as ev_points from props where {VALID} and {EV} > 0",
)
def f6(spark, sf):
    return policy.propose_from_bars(views.bars(spark, sf)).select("*", _points()).drop("tf", "ev")


BARRIER = f"""{with_averages(ATR14)}, t as (select *, close + 1.5e0 * atr as up, close - atr as down,
  count(*) over (partition by symbol) as total from a),
  first_ as (select t.symbol, t.rn, min(x.rn) as met from t join a x on x.symbol = t.symbol
  and x.rn between t.rn + 1 and t.rn + {{h}} and (x.high >= t.up or x.low <= t.down) group by 1, 2),
  tb as (select t.symbol, t.bar_ts, t.up, t.down, case when x.low <= t.down then -1 when x.rn is not null then 1
  when t.rn + {{h}} <= t.total then 0 end as label, x.bar_ts as touch_ts from t
  left join first_ f on f.symbol = t.symbol and f.rn = t.rn
  left join a x on x.symbol = f.symbol and x.rn = f.met)"""


def _barriers(spark, sf, horizon):
    atr = F.col("atr")
    return labels.triple_barrier(views.bars(spark, sf), 1.5 * atr, atr, horizon, [ft.atr()])


@query(
    "f1_triple_barrier",
    f"""{BARRIER.format(h=24)} select symbol, bar_ts, {r('up')} as tp_level, {r('down')} as sl_level, label::double as label,
  touch_ts from tb""",
)
def f1(spark, sf):
    return _barriers(spark, sf, 24).withColumn("label", F.col("label").cast("double")).drop("tf")


@query(
    "f1_triple_barrier_long",
    f"""{BARRIER.format(h=2000).replace('1.5e0 * atr as up, close - atr as down', '24e0 * atr as up, close - 16e0 * atr as down')}
  select symbol, bar_ts, {r('up')} as tp_level, {r('down')} as sl_level, label::double as label, touch_ts from tb""",
)
def f1_long(spark, sf):
    atr = F.col("atr")
    wide = labels.triple_barrier(views.bars(spark, sf), 24 * atr, 16 * atr, 2000, [ft.atr()])
    return wide.withColumn("label", F.col("label").cast("double")).drop("tf")


@query(
    "c9_label_mix",
    f"""{BARRIER.format(h=3)} select symbol, count(*) filter (label = -1) as label_m1,
  count(*) filter (label = 0) as label_0, count(*) filter (label = 1) as label_1 from tb group by 1""",
)
def c9(spark, sf):
    return metrics.label_mix(_barriers(spark, sf, 3), "label", [-1, 0, 1], ["symbol"])


FILLED = f"""{PROPOSALS}, total as (select symbol, count(*) as total from bars group by 1),
  ff as (select p.symbol, p.rn, min(x.rn) as fill from props p join a x on x.symbol = p.symbol
  and x.rn between p.rn + 1 and p.rn + 6 and case when p.way > 0 then x.low <= p.entry else x.high >= p.entry end
  group by 1, 2),
  fl as materialized (select p.*, ff.fill, total, case when ff.fill is not null then 'FILLED'
  when p.rn + 6 <= total then 'EXPIRED' else 'PENDING' end as status from props p join total using (symbol)
  left join ff using (symbol, rn))"""


@query(
    "f2_limit_fill",
    f"""{FILLED} select fl.symbol, fl.bar_ts, side, status, x.bar_ts as status_ts from fl
  left join a x on x.symbol = fl.symbol and x.rn = coalesce(fl.fill, fl.rn + 6)""",
)
def f2(spark, sf):
    filled = labels.limit_fill(_proposals(spark, sf), views.bars(spark, sf), max_expiry=6)
    return filled.select(*KEY, "side", "status", "status_ts")


MOVED = f"""{PROPOSALS}, moved as (select * replace (case when hour(bar_ts) = 3 then bar_ts - interval 400 days
  when day(bar_ts) % 2 = 1 then bar_ts + interval 7 minutes else bar_ts end as bar_ts,
  (1 + hour(bar_ts) % 6)::int as expiry_bars, case when hour(bar_ts) = 3 then null else rn end as rn) from props),
  total as (select symbol, count(*) as total from bars group by 1),
  ff as (select p.symbol, p.rn, min(x.rn) as fill from moved p join a x on x.symbol = p.symbol
  and x.rn between p.rn + 1 and p.rn + p.expiry_bars
  and case when p.way > 0 then x.low <= p.entry else x.high >= p.entry end group by 1, 2),
  fl as materialized (select p.*, ff.fill, total, case when p.rn is null then 'NO_BAR' when ff.fill is not null then 'FILLED'
  when p.rn + p.expiry_bars <= total then 'EXPIRED' else 'PENDING' end as status from moved p join total using (symbol)
  left join ff using (symbol, rn))"""


def _moved(spark, sf):
    """Orders off the grid of the bars, before the first bar, and of varying expiry."""
    hour = F.hour("bar_ts")
    moved = (
        F.when(hour == 3, F.col("bar_ts") - F.expr("interval 400 days"))
        .when(F.dayofmonth("bar_ts") % 2 == 1, F.col("bar_ts") + F.expr("interval 7 minutes"))
        .otherwise(F.col("bar_ts"))
    )
    return _proposals(spark, sf).withColumns({"bar_ts": moved, "expiry_bars": (1 + hour % 6).cast("int")})


@query(
    "f2_limit_fill_off_grid",
    f"""{MOVED} select fl.symbol, fl.bar_ts, side, expiry_bars, status, x.bar_ts as status_ts from fl
  left join a x on x.symbol = fl.symbol and x.rn = coalesce(fl.fill, fl.rn + fl.expiry_bars)""",
)
def f2_off_grid(spark, sf):
    filled = labels.limit_fill(_moved(spark, sf), views.bars(spark, sf))
    return filled.select(*KEY, "side", "expiry_bars", "status", "status_ts")


@query(
    "f3_order_outcome",
    f"""{FILLED}, met as (select p.symbol, p.rn, min(x.rn) as met from fl p join a x on x.symbol = p.symbol
  and x.rn between p.fill + 1 and p.fill + 24 and case when p.way > 0 then x.low <= p.sl or x.high >= p.tp
  else x.high >= p.sl or x.low <= p.tp end group by 1, 2),
  o as (select fl.*, case when status <> 'FILLED' then status when met is null and fill + 24 > total then 'OPEN'
  when met is null then 'TIMEOUT' when (way > 0 and x.low <= sl) or (way < 0 and x.high >= sl) then 'SL'
  else 'TP' end as outcome from fl left join met using (symbol, rn)
  left join a x on x.symbol = fl.symbol and x.rn = met.met)
  select o.symbol, o.bar_ts, side, outcome, {r('''case outcome when 'EXPIRED' then 0e0 when 'SL' then way * (sl - entry)
  when 'TP' then way * (tp - entry) when 'TIMEOUT' then way * (z.close - entry) end''')} as pnl
  from o left join a z on z.symbol = o.symbol and z.rn = o.fill + 24""",
)
def f3(spark, sf):
    played = labels.order_outcome(_proposals(spark, sf), views.bars(spark, sf), 6, 24)
    return played.select(*KEY, "side", "outcome", "pnl")


@query(
    "f3_order_outcome_off_grid",
    f"""{MOVED}, met as (select p.symbol, p.rn, min(x.rn) as met from fl p join a x on x.symbol = p.symbol
  and x.rn between p.fill + 1 and p.fill + 24 and case when p.way > 0 then x.low <= p.sl or x.high >= p.tp
  else x.high >= p.sl or x.low <= p.tp end group by 1, 2),
  o as (select fl.*, case when status <> 'FILLED' then status when met is null and fill + 24 > total then 'OPEN'
  when met is null then 'TIMEOUT' when (way > 0 and x.low <= sl) or (way < 0 and x.high >= sl) then 'SL'
  else 'TP' end as outcome from fl left join met using (symbol, rn)
  left join a x on x.symbol = fl.symbol and x.rn = met.met)
  select o.symbol, o.bar_ts, side, outcome, {r('''case outcome when 'EXPIRED' then 0e0 when 'SL' then way * (sl - entry)
  when 'TP' then way * (tp - entry) when 'TIMEOUT' then way * (z.close - entry) end''')} as pnl
  from o left join a z on z.symbol = o.symbol and z.rn = o.fill + 24""",
)
def f3_off_grid(spark, sf):
    played = labels.order_outcome(_moved(spark, sf), views.bars(spark, sf), None, 24)
    return played.select(*KEY, "side", "outcome", "pnl")


MIXED = MOVED.replace(
    "(1 + hour(bar_ts) % 6)::int", "(case hour(bar_ts) when 5 then 3000 when 7 then 1000000 else 1 + hour(bar_ts) % 6 end)::int"
)


@query(
    "f3_order_outcome_mixed",
    f"""{MIXED}, met as (select p.symbol, p.rn, min(x.rn) as met from fl p join a x on x.symbol = p.symbol
  and x.rn between p.fill + 1 and p.fill + 3000 and case when p.way > 0 then x.low <= p.sl or x.high >= p.tp
  else x.high >= p.sl or x.low <= p.tp end group by 1, 2)
  select fl.symbol, fl.bar_ts, side, expiry_bars, status, f.bar_ts as status_ts, case when status <> 'FILLED' then status
  when met is null and fill + 3000 > total then 'OPEN' when met is null then 'TIMEOUT'
  when (way > 0 and x.low <= sl) or (way < 0 and x.high >= sl) then 'SL' else 'TP' end as outcome
  from fl left join met using (symbol, rn) left join a x on x.symbol = fl.symbol and x.rn = met.met
  left join a f on f.symbol = fl.symbol and f.rn = coalesce(fl.fill, fl.rn + fl.expiry_bars)""",
)
def f3_mixed(spark, sf):
    """Short orders beside some that wait for thousands of bars, or far longer than there are any."""
    hour = F.hour("bar_ts")
    expiry = F.when(hour == 5, 3000).when(hour == 7, 1_000_000).otherwise(1 + hour % 6).cast("int")
    orders = _moved(spark, sf)
    played = labels.order_outcome(orders.withColumn("expiry_bars", expiry), views.bars(spark, sf), None, 3000)
    return played.select(*KEY, "side", "expiry_bars", "status", "status_ts", "outcome")


GRID = f"""{with_averages({**ATR14, 'fast': ('tr', 1 / 5), 'slow': ('tr', 1 / 50)})},
  g as (select * from (values (0.1e0), (0.4e0)) d(discount), (values (0.5e0), (1e0), (2e0)) s(stop),
  (values (1e0), (2e0)) t(target)),
  o as materialized (select a.symbol, a.rn, atr, case when fast / nullif(slow, 0) > 1 then 'expanding' when slow <> 0 then 'calm' end as regime,
  discount, stop, target, close - discount * atr as entry, close - discount * atr - stop * atr as sl,
  close - discount * atr + target * atr as tp, count(*) over (partition by symbol, discount, stop, target) as total
  from a, g),
  ff as (select o.symbol, o.rn, discount, stop, target, min(x.rn) as fill from o join a x on x.symbol = o.symbol
  and x.rn between o.rn + 1 and o.rn + 4 and x.low <= o.entry group by 1, 2, 3, 4, 5),
  fl as materialized (select o.*, fill from o left join ff using (symbol, rn, discount, stop, target)),
  met as (select o.symbol, o.rn, discount, stop, target, min(x.rn) as met from fl o join a x on x.symbol = o.symbol
  and x.rn between o.fill + 1 and o.fill + 12 and (x.low <= o.sl or x.high >= o.tp) group by 1, 2, 3, 4, 5),
  p as (select fl.*, case when fill is null and fl.rn + 4 <= total then 0e0 when fill is null then null
  when met is null and fill + 12 > total then null when met is null then z.close - entry
  when x.low <= sl then sl - entry else tp - entry end as pnl
  from fl left join met using (symbol, rn, discount, stop, target)
  left join a x on x.symbol = fl.symbol and x.rn = met left join a z on z.symbol = fl.symbol and z.rn = fill + 12),
  grid as (select regime, discount, stop, target, count(*) as n,
  avg(case when fill is not null then 1e0 else 0e0 end) as fill_rate, avg(pnl / nullif(atr, 0)) as ev
  from p where pnl is not null group by 1, 2, 3, 4)"""


def _grid(spark, sf):
    return policy.policy_grid(
        views.bars(spark, sf), [0.1, 0.4], [0.5, 1.0, 2.0], [1.0, 2.0], expiry_bars=4, horizon=12
    )


@query(
    "f5_policy_grid",
    f"""{GRID} select regime, discount, stop, target, n, {r('fill_rate')} as fill_rate, {r('ev')} as ev
  from grid""",
)
def f5(spark, sf):
    return _grid(spark, sf)


@query(
    "f5_best_policy",
    f"""{GRID} select regime, discount, stop, target, n, {r('fill_rate')} as fill_rate, {r('ev')} as ev
  from (select *, row_number() over (partition by regime order by ev desc, discount, stop, target) as k from grid)
  where k = 1""",
)
def f5_best(spark, sf):
    return policy.best_policy(_grid(spark, sf))


ODDS = "(abs(tp - entry) / abs(entry - sl))"
KELLY = f"greatest(least(p_win - (1 - p_win) / {ODDS}, 0.2e0), 0)"


# The smallest steps in whole numbers: budget in 1e-9, stop in 1e-5, lot step in 1e-2.
BUDGET = "round(10000e0 * least(kelly, 0.02e0) * 1e9)::hugeint"
STOP = "round(abs(entry - sl) * 1e5)::hugeint"
SYMBOLS = """symbols as (select symbol, (length(symbol) * 100)::double as contract_size,
  case when length(symbol) % 2 = 0 then 0.01e0 else 0.1e0 end as lot_step, 0.00001e0 as tick_size
  from (select distinct event_type as symbol from events))"""


@query(
    "f7_size_lots",
    f"""{PROPOSALS}, {SYMBOLS}, k as (select props.*, {KELLY} as kelly, contract_size::hugeint as contract,
  round(lot_step * 100)::hugeint as step from props join symbols using (symbol))
  select symbol, bar_ts, {r('kelly')} as kelly,
  {r(f'(({BUDGET}) // (({STOP}) * contract * step * 100) * step)::double / 100')} as lots from k""",
)
def f7(spark, sf):
    orders = _proposals(spark, sf).withColumn("equity", F.lit(10000.0))
    return risk.size_lots(orders, 0.02, 0.2, symbols(spark, sf)).select(*KEY, "kelly", "lots")


def symbols(spark, sf):
    """A catalogue with different contracts and lot steps for the test symbols."""
    names = views.ticks(spark, sf).select("symbol").distinct()
    size = F.length("symbol")
    return names.select(
        "symbol", (size * 100).cast("double").alias("contract_size"),
        F.when(size % 2 == 0, 0.01).otherwise(0.1).alias("lot_step"), F.lit(0.00001).alias("tick_size"),
    )


# --- accounts -------------------------------------------------------------

QUOTED = f"""with {TICKS}, {POSITIONS}, q as (select symbol, price as quote, spread as quote_spread from
  (select *, row_number() over (partition by symbol order by ts desc, tick_id desc) as k from ticks) where k = 1),
  v as (select p.*, quote, case when side = 'BUY' then quote - quote_spread / 2 - entry
  else entry - quote - quote_spread / 2 end * volume as floating_pnl from positions p left join q using (symbol))"""


def _e3(c: str):
    """Values with nine exact digits in thousandths, so that rounding meets no ties."""
    return (F.col(c) * 1e3).alias(f"{c}_e3")


def _valued(spark, sf):
    return joins.floating_pnl(views.positions(spark, sf), joins.quotes(views.ticks(spark, sf)))


@query(
    "e3_floating_pnl",
    f"{QUOTED} select ticket, account_id, symbol, quote, {r('floating_pnl * 1e3')} as floating_pnl_e3 from v",
)
def e3(spark, sf):
    return _valued(spark, sf).select("ticket", "account_id", "symbol", "quote", _e3("floating_pnl"))


@query(
    "e4_equity",
    f"""{QUOTED}, f as (select account_id, sum(floating_pnl) as fp, count(*) as n from v group by 1)
  select c_custkey as account_id, c_acctbal as balance, {r('coalesce(fp, 0) * 1e3')} as floating_pnl_e3,
  coalesce(n, 0) as positions, {r('(c_acctbal + coalesce(fp, 0)) * 1e3')} as equity_e3
  from customer left join f on f.account_id = c_custkey""",
)
def e4(spark, sf):
    accounts = joins.equity(views.accounts(spark, sf), _valued(spark, sf))
    return accounts.select("account_id", "balance", _e3("floating_pnl"), "positions", _e3("equity"))


UNQUOTED = QUOTED.replace("from ticks)", "from ticks where symbol <> 'click')")


@query(
    "e4_equity_unquoted",
    f"""{UNQUOTED}, f as (select account_id, sum(floating_pnl) as fp, count(*) as n,
  count(*) - count(floating_pnl) as unvalued from v group by 1)
  select c_custkey as account_id, case when coalesce(unvalued, 0) = 0 then {r('coalesce(fp, 0) * 1e3')} end as floating_pnl_e3,
  coalesce(n, 0) as positions, coalesce(unvalued, 0) as unvalued,
  case when coalesce(unvalued, 0) = 0 then {r('(c_acctbal + coalesce(fp, 0)) * 1e3')} end as equity_e3
  from customer left join f on f.account_id = c_custkey""",
)
def e4_unquoted(spark, sf):
    ticks = views.ticks(spark, sf).filter(F.col("symbol") != "click")
    valued = joins.floating_pnl(views.positions(spark, sf), joins.quotes(ticks))
    found = joins.equity(views.accounts(spark, sf), valued)
    return found.select("account_id", _e3("floating_pnl"), "positions", "unvalued", _e3("equity"))


LIVES = f"""with recursive {ORDER_EVENTS}, l as materialized (select *, row_number() over (partition by order_id
  order by ts, event_id) as rn from order_events where kind <> 'QUOTE'),
  st as (select order_id, rn, ts, case when kind = 'PLACE' then ts end as placed,
  case when kind = 'PLACE' then event_id end as pid, null::bigint as event_id, null::timestamp as was,
  null::varchar as state, null::timestamp as ended from l where rn = 1 union all
  select l.order_id, l.rn, l.ts,
  case when l.kind = 'PLACE' and (s.placed is null or l.ts > s.placed + interval 1 day) then l.ts
  when l.kind = 'PLACE' then s.placed end,
  case when l.kind = 'PLACE' and (s.placed is null or l.ts > s.placed + interval 1 day) then l.event_id
  when l.kind = 'PLACE' then s.pid end,
  case when s.placed is not null and (l.ts > s.placed + interval 1 day or l.kind <> 'PLACE') then s.pid end,
  s.placed, case when s.placed is null then null when l.ts > s.placed + interval 1 day then 'EXPIRED'
  when l.kind = 'FILL' then 'FILLED' when l.kind = 'CANCEL' then 'CANCELLED' when l.kind = 'REJECT' then 'REJECTED' end,
  case when l.ts > s.placed + interval 1 day then s.placed + interval 1 day when l.kind <> 'PLACE' then l.ts end
  from st s join l on l.order_id = s.order_id and l.rn = s.rn + 1),
  lives as (select order_id, event_id, was as placed, state, ended from st where event_id is not null union all
  select order_id, pid, placed, case when placed + interval 1 day < m then 'EXPIRED' else 'PENDING' end,
  case when placed + interval 1 day < m then placed + interval 1 day end from
  (select *, row_number() over (partition by order_id order by rn desc) as k from st),
  (select max(ts) as m from events) where k = 1 and placed is not null)"""


def _lives(spark, sf):
    log = views.order_events(spark, sf)
    return risk.order_states(log, "1 day", log.agg(F.max("ts")).scalar())


@query("j4_order_states", f"{LIVES} select order_id, event_id, placed, state, ended from lives")
def j4(spark, sf):
    return _lives(spark, sf)


@query(
    "f8_liquidation_set",
    f"""{LIVES}, {QUOTED.removeprefix('with ')} select 'CLOSE' as action, ticket as id,
  case when side = 'BUY' then 'SELL' else 'BUY' end as side, volume, quote as price,
  {r('floating_pnl * 1e3')} as floating_pnl_e3 from v union all
  select 'CANCEL', event_id, null, null, null, null from lives where state = 'PENDING'""",
)
def f8(spark, sf):
    pending = _lives(spark, sf).filter(F.col("state") == "PENDING")
    rows = risk.liquidation_set(_valued(spark, sf), pending)
    return rows.select("action", "id", "side", "volume", "price", _e3("floating_pnl"))


GATED = f"""with recursive {TICKS}, {TRADES}, p as materialized (select account_id, trade_id, open_ts, close_ts, pnl,
  spread, date_trunc('minute', open_ts) as mi, cast(open_ts as date) as day from trades join ticks on tick_id = trade_id),
  s as materialized (select *, row_number() over (partition by account_id order by open_ts, trade_id) as rn
  from p where spread <= 0.4),
  st as (select account_id, day, rn, trade_id, 0e0 as booked, [{{'c': close_ts, 'pnl': pnl}}] as held,
  'ACCEPT' as reason from s where rn = 1 union all
  select account_id, day, rn, trade_id, booked2, case when booked2 <= -40 or len(still) >= 2 then still
  else list_append(still, {{'c': close_ts, 'pnl': pnl}}) end,
  case when booked2 <= -40 then 'DAILY_LOSS' when len(still) >= 2 then 'MAX_OPEN' else 'ACCEPT' end
  from (select s.*, list_filter(held, lambda o: o.c >= s.mi) as still,
  case when st.day = s.day then booked else 0 end + coalesce(list_sum(list_transform(list_filter(held,
    lambda o: o.c < s.mi and cast(o.c as date) = s.day), lambda o: o.pnl)), 0) as booked2
  from st join s on s.account_id = st.account_id and s.rn = st.rn + 1)),
  decided as (select p.trade_id, p.account_id, p.open_ts, coalesce(st.reason, 'SPREAD') as reason
  from p left join st on st.trade_id = p.trade_id)"""


def _gated(spark, sf):
    offers = views.offers_view(views.events(spark, sf))
    return risk.risk_gate(offers, max_spread=0.4, max_open=2, daily_loss=40.0)


@query(
    "j5_risk_gate",
    f"""{GATED} select trade_id, account_id, open_ts, reason,
  case when reason = 'ACCEPT' then 'ACCEPT' else 'REJECT' end as decision from decided""",
)
def j5(spark, sf):
    return _gated(spark, sf).select("trade_id", "account_id", "open_ts", "reason", "decision")


UNCLOSED = (
    GATED.replace(
        "open_ts, close_ts, pnl,",
        "open_ts, case when trade_id % 3 = 0 then timestamp '9999-12-31' else close_ts end as close_ts, pnl,",
    )
    .replace("booked2 <= -40", "booked2 <= -400")
    .replace("len(still) >= 2", "len(still) >= 40")
)


@query(
    "j5_risk_gate_unclosed",
    f"""{UNCLOSED} select trade_id, account_id, open_ts, reason,
  case when reason = 'ACCEPT' then 'ACCEPT' else 'REJECT' end as decision from decided""",
)
def j5_unclosed(spark, sf):
    """A third of the trades never closes."""
    offers = views.offers_view(views.events(spark, sf))
    open_ended = F.when(F.col("trade_id") % 3 != 0, F.col("close_ts"))
    decided = risk.risk_gate(offers.withColumn("close_ts", open_ended), max_spread=0.4, max_open=40, daily_loss=400.0)
    return decided.select("trade_id", "account_id", "open_ts", "reason", "decision")


# --- validation -----------------------------------------------------------

EMBARGO = timedelta(hours=6)
# Four equal test periods after a first stretch that only trains, over all of the bars' time.
FOLD_SQL = """f as (select i::int as fold, lo + (hi - lo) * i / 5 as lo, lo + (hi - lo) * (i + 1) / 5 as hi from
  (select min(bar_ts) as lo, max(bar_ts) + interval 1 hour as hi from bars), range(1, 5) x(i))"""


def folds(bars):
    lo, hi = bars.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    return validation.equal_folds(lo, hi + timedelta(hours=1), 4)


@query(
    "e5_purged_folds",
    f"""{bars()}, {FOLD_SQL}, b as (select symbol, bar_ts,
  bar_ts + interval 24 hours as label_end from bars)
  select symbol, bar_ts, label_end, fold, case when bar_ts >= lo and bar_ts < hi then 'test' else 'train' end as role
  from b join f on (bar_ts >= lo and bar_ts < hi) or label_end < lo - interval 6 hours""",
)
def e5(spark, sf):
    rows = views.bars(spark, sf).select(*KEY).withColumn(
        "label_end", F.col("bar_ts") + F.expr("interval 24 hours")
    )
    return validation.purged_folds(rows, folds(views.bars(spark, sf)), EMBARGO)


def _reversion(spark, sf):
    """Level-reversion rule: above the mean of the previous 50 closes, expect a fall."""

    def rule(df, w):
        return df.withColumns(
            {
                "_m": F.avg("close").over(w.rowsBetween(-50, -1)),
                "_next": F.lead("close").over(w),
            }
        )

    rows = tiles.tiled(views.bars(spark, sf), rule, before=50, after=1)
    rows = rows.filter(F.col("_m").isNotNull() & F.col("_next").isNotNull())
    return rows.select(
        *KEY,
        (F.col("close") <= F.col("_m")).alias("predicted"),
        (F.col("_next") > F.col("close")).alias("outcome"),
    )


@query(
    "g2_permutation_test",
    f"""{bars()}, s as materialized (select symbol, bar_ts, close <= m as predicted, nx > close as outcome,
  row_number() over (partition by symbol order by bar_ts) as pos from (select *,
  avg(close) over {OVER.format(50, '1 preceding')} as m,
  lead(close) over (partition by symbol order by bar_ts) as nx from bars) where m is not null and nx is not null),
  d as (select s.symbol, run, outcome, row_number() over (partition by s.symbol, run
  order by md5('7|' || run || '|' || s.symbol || '|' || bar_ts)) as pos from s, range(1, 21) runs(run)),
  j as (select run::int as run, predicted, d.outcome from d join s on s.symbol = d.symbol and s.pos = d.pos union all
  select 0, predicted, outcome from s)
  select run, count(*) as n, {r('avg(case when predicted = outcome then 1e0 else 0e0 end)')} as hit_rate
  from j group by 1""",
)
def g2(spark, sf):
    return validation.permutation_test(_reversion(spark, sf), runs=20, seed=7)


# The base case, and the stress of three times the spread and 150 ms.
SCENARIOS = [("base", 1.0, 0), ("spread_x3", 3.0, 0), ("slip_150ms", 1.0, 150), ("both", 3.0, 150)]


def _sided(spark, sf):
    side = F.when(F.col("trade_id") % 2 == 0, "BUY").otherwise("SELL")
    return views.trades(spark, sf).drop("pnl").withColumn("side", side)


@query(
    "g3_friction_shock",
    f"""with {TICKS}, {TRADES}, sc(scenario, mult, ms) as (values {', '.join(f"('{n}', {m}e0, {s})" for n, m, s in SCENARIOS)}),
  w as (select *, case when trade_id % 2 = 0 then 1e0 else -1e0 end as way, open_ts + to_milliseconds(ms) as t_in,
  close_ts + to_milliseconds(ms) as t_out from trades, sc),
  i as (select w.*, price as p_in, spread as s_in from w asof join ticks on ticks.symbol = w.symbol and ticks.ts <= t_in),
  o as (select i.*, price as p_out from i asof join ticks on ticks.symbol = i.symbol and ticks.ts <= t_out),
  z as (select strategy_id, scenario, way * (p_out - p_in) - mult * s_in as pnl from o)
  select strategy_id, scenario, {STATS} from z group by 1, 2""",
)
def g3(spark, sf):
    shocked = validation.friction_shock(_sided(spark, sf), views.ticks(spark, sf), SCENARIOS)
    return metrics.trade_stats(shocked, ["strategy_id", "scenario"])


HALF = "(select min(ts) + (max(ts) - min(ts)) / 2 from events)"


@query(
    "g3_friction_shock_unquoted",
    f"""with {TICKS}, {TRADES}, late as (select * from ticks where ts >= {HALF}),
  sc(scenario, mult, ms) as (values {', '.join(f"('{n}', {m}e0, {s})" for n, m, s in SCENARIOS)}),
  w as (select *, case when trade_id % 2 = 0 then 1e0 else -1e0 end as way, open_ts + to_milliseconds(ms) as t_in,
  close_ts + to_milliseconds(ms) as t_out from trades, sc),
  i as (select w.*, price as p_in, spread as s_in from w asof left join late on late.symbol = w.symbol and late.ts <= t_in),
  o as (select i.*, price as p_out from i asof left join late on late.symbol = i.symbol and late.ts <= t_out)
  select strategy_id, scenario, trade_id, case when p_in is null or p_out is null then 'NO_QUOTE' else 'PRICED' end as status,
  {r('way * (p_out - p_in) - mult * s_in')} as pnl from o""",
)
def g3_unquoted(spark, sf):
    """Quotes begin in the middle of the trades."""
    ticks = views.ticks(spark, sf)
    lo, hi = ticks.agg(F.min("ts"), F.max("ts")).first()
    late = ticks.filter(F.col("ts") >= F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz"))
    return validation.friction_shock(_sided(spark, sf), late, SCENARIOS)


def mc_sql(blocks: str, length: int = 1) -> str:
    return f"""{blocks}, sized as (select *, count(*) over (partition by strategy_id) as n from blk),
  d as (select strategy_id, run, block_no as pos, cast('0x' || substr(md5('11|' || run || '|' || strategy_id || '|' ||
  block_no), 1, 15) as bigint) % n as pick from sized, range(1, 1001) runs(run) where block_no < (n + {length} - 1) / {length}::double),
  x as (select d.strategy_id, run, pos, total, top, fall, blk.drop_ as drop_, coalesce(sum(total) over (w rows between
  unbounded preceding and 1 preceding), 0) as base from d join blk on blk.strategy_id = d.strategy_id
  and blk.block_no = d.pick window w as (partition by d.strategy_id, run order by pos)),
  y as (select *, greatest(0, max(base + top) over (partition by strategy_id, run order by pos rows between
  unbounded preceding and 1 preceding)) as peak from x),
  sim as (select strategy_id, run, sum(total) as profit, max(greatest(drop_, peak - base - fall)) as dd from y group by 1, 2)
  select strategy_id, count(*) as runs, {r('quantile_cont(dd, 0.5)')} as dd_p50,
  {r('quantile_cont(dd, 0.95)')} as dd_p95, {r('quantile_cont(dd, 0.99)')} as dd_p99, {r('max(dd)')} as dd_worst,
  {r('avg(case when profit < 0 then 1e0 else 0e0 end)')} as loss_share from sim group by 1"""


TRADE_BLOCKS = f"""with {TRADES}, blk as materialized (select strategy_id, row_number() over (partition by strategy_id
  order by close_ts, trade_id) - 1 as block_no, pnl as total, greatest(pnl, 0) as top, least(pnl, 0) as fall,
  greatest(-pnl, 0) as drop_ from trades)"""

DAY_BLOCKS = f"""with {TRADES}, eq as (select strategy_id, cast(close_ts as date) as day, pnl, sum(pnl) over
  (partition by strategy_id, cast(close_ts as date) order by close_ts, trade_id) as eq, close_ts, trade_id from trades),
  pk as (select *, greatest(0, max(eq) over (partition by strategy_id, day order by close_ts, trade_id)) as peak from eq),
  blk as materialized (select strategy_id, row_number() over (partition by strategy_id order by day) - 1 as block_no,
  sum(pnl) as total, greatest(max(eq), 0) as top, least(min(eq), 0) as fall, max(peak - eq) as drop_
  from pk group by strategy_id, day)"""


def moving_sql(length: int) -> str:
    return f"""with {TRADES}, t as (select strategy_id, pnl, row_number() over (partition by strategy_id
  order by close_ts, trade_id) - 1 as no, count(*) over (partition by strategy_id) as many from trades),
  j as (select a.strategy_id, a.no as block_no, b.no, b.pnl, sum(b.pnl) over (partition by a.strategy_id, a.no order by b.no) as eq
  from t a join t b on a.strategy_id = b.strategy_id and b.no between a.no and a.no + {length} - 1
  where a.no + {length} <= a.many or a.no = 0),
  k as (select *, greatest(0, max(eq) over (partition by strategy_id, block_no order by no)) as peak from j),
  blk as materialized (select strategy_id, block_no, sum(pnl) as total, greatest(max(eq), 0) as top,
  least(min(eq), 0) as fall, max(peak - eq) as drop_ from k group by 1, 2)"""


def _simulated(blocks, length=1):
    by = ["strategy_id"]
    drawn = validation.mc_drawdown(blocks, by, runs=1000, seed=11, length=length)
    return validation.drawdown_report(drawn, by)


@query("g4_mc_drawdown_blocks", mc_sql(moving_sql(25), 25))
def g4_blocks(spark, sf):
    return _simulated(validation.moving_blocks(views.trades(spark, sf), ["strategy_id"], 25), 25)


@query("g4_mc_drawdown", mc_sql(TRADE_BLOCKS))
def g4(spark, sf):
    return _simulated(validation.trade_blocks(views.trades(spark, sf), ["strategy_id"]))


@query("g4_mc_drawdown_days", mc_sql(DAY_BLOCKS))
def g4_days(spark, sf):
    return _simulated(validation.day_blocks(views.trades(spark, sf), ["strategy_id"]))


@query(
    "g5_gates",
    f"""with recursive {TRADES}, {DRAWDOWN}, {DEFLATED}, s as (select strategy_id, {STATS} from trades group by 1),
  j as (select s.*, max_drawdown, dsr from s join dd using (strategy_id) join ds using (strategy_id))
  select strategy_id, {r('max_drawdown')} as max_drawdown, profit_factor, win_rate, {r('dsr')} as dsr,
  array_to_string(list_filter([case when profit_factor >= 1.02 then null else 'profit_factor' end,
  case when win_rate >= 0.35 then null else 'win_rate' end, case when max_drawdown <= 4000 then null else 'max_drawdown' end,
  case when dsr >= 0.4 then null else 'dsr' end], lambda x: x is not null), ',') as reasons,
  profit_factor >= 1.02 and win_rate >= 0.35 and max_drawdown <= 4000 and dsr >= 0.4 as passed from j""",
)
def g5(spark, sf):
    by = ["strategy_id"]
    report = metrics.proof_report(views.trades(spark, sf), by)
    rules = validation.default_gates(min_factor=1.02, min_win=0.35, max_fall=4000.0, min_dsr=0.4)
    judged = validation.gates(report, rules)
    return judged.select(
        *by, "max_drawdown", "profit_factor", "win_rate", "dsr", F.array_join("reasons", ",").alias("reasons"), "passed"
    )
