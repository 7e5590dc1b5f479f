"""Bar features, samples, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as bar_ops
from barloom.operators import features as ft
from barloom.operators import joins, recurrence, samples
from barloom.plans.data_queries import local
from barloom.plans.oracle import ROWS, TICKS, averages, bars, bars_of, r, with_averages
from barloom.plans.registry import query
from barloom.session import fresh_dir, store
from barloom.sources import files, views

KEY = ["symbol", "bar_ts"]


def _features(spark, sf, *features):
    outputs = [o for f in features for o in f.outputs]
    return ft.compute(views.bars(spark, sf), *features).select(*KEY, *outputs)


PART = "case when high = low then 0e0 else ({}) / (high - low) end"
BODY = PART.format("abs(close - open)")
UPPER, LOWER = PART.format("high - greatest(open, close)"), PART.format("least(open, close) - low")


@query("d1_body_ratio", f"{bars()} select symbol, bar_ts, {r(BODY)} as body_ratio from bars")
def d1(spark, sf):
    return _features(spark, sf, ft.body_ratio())


@query(
    "d2_wick_ratios",
    f"{bars()} select symbol, bar_ts, {r(UPPER)} as upper_wick, {r(LOWER)} as lower_wick from bars",
)
def d2(spark, sf):
    return _features(spark, sf, ft.wick_ratios())


@query("d3_true_range", f"{bars()}, {ROWS} select symbol, bar_ts, {r('tr')} as tr from rows_")
def d3(spark, sf):
    return _features(spark, sf, ft.true_range())


ATR14 = {"atr": ("tr", 1 / 14)}


@query("d4_atr", f"{with_averages(ATR14)} select symbol, bar_ts, {r('atr')} as atr from a")
def d4(spark, sf):
    return _features(spark, sf, ft.atr())


@query(
    "d5_range_to_atr",
    f"{with_averages(ATR14)} select symbol, bar_ts, {r('(high - low) / nullif(atr, 0)')} as range_to_atr from a",
)
def d5(spark, sf):
    return _features(spark, sf, ft.range_to_atr())


@query(
    "d6_ema",
    f"{with_averages({'ema': ('close', 2 / 13)})} select symbol, bar_ts, {r('ema')} as ema from a",
)
def d6(spark, sf):
    return _features(spark, sf, ft.ema(n=12))


OVER = "(partition by symbol order by bar_ts rows between {} preceding and {})"
W50 = OVER.format(49, "current row")


@query(
    "d7_ema_z",
    f"""{with_averages({'e': ('close', 2 / 21)})}, d as (select *, close / e - 1 as dev from a)
  select symbol, bar_ts, {r(f'(dev - avg(dev) over {W50}) / nullif(stddev_samp(dev) over {W50}, 0)')}
  as ema_z from d""",
)
def d7(spark, sf):
    return _features(spark, sf, ft.ema_z())


GAIN = "coalesce(greatest(close - pc, 0), 0)"
LOSS = "coalesce(greatest(pc - close, 0), 0)"


@query(
    "d8_rsi",
    f"""{with_averages({'g': (GAIN, 1 / 14), 'l': (LOSS, 1 / 14)})} select symbol, bar_ts,
  {r('case when g + l = 0 then 0e0 else (100 * g / (g + l) - 50) / 50 end')} as rsi from a""",
)
def d8(spark, sf):
    return _features(spark, sf, ft.rsi())


MACD = {"f": ("close", 2 / 13), "s": ("close", 2 / 27)}


@query(
    "d9_macd_ratio",
    f"""{with_averages(MACD)}, m as materialized (select *, (f - s) / close as macd from a),
  {averages('sig', {'signal': ('macd', 2 / 10)}, 'm')}
  select m.symbol, bar_ts, {r('macd')} as macd, {r('signal')} as macd_signal,
  {r('macd - signal')} as macd_hist from m join sig on sig.symbol = m.symbol and sig.rn = m.rn""",
)
def d9(spark, sf):
    return _features(spark, sf, ft.macd_ratio())


@query("d10_natr", f"{with_averages(ATR14)} select symbol, bar_ts, {r('atr / close')} as natr from a")
def d10(spark, sf):
    return _features(spark, sf, ft.natr())


W20 = OVER.format(19, "current row")


@query(
    "d11_bb_width",
    f"""{bars()} select symbol, bar_ts,
  {r(f'4 * (stddev_pop(close) over {W20}) / (avg(close) over {W20})')} as bb_width from bars""",
)
def d11(spark, sf):
    return _features(spark, sf, ft.bb_width())


@query(
    "d12_vol_expansion",
    f"""{with_averages({'fast': ('tr', 1 / 5), 'slow': ('tr', 1 / 50)})} select symbol, bar_ts,
  {r('fast / nullif(slow, 0)')} as vol_expansion from a""",
)
def d12(spark, sf):
    return _features(spark, sf, ft.vol_expansion())


def _hours(zone: str, lo: int, hi: int) -> str:
    at = f"hour({local('bar_ts', zone)})"
    return f"({at} >= {lo} and {at} < {hi})"


LONDON = _hours("Europe/London", 8, 17)


@query(
    "d13_session_masks",
    f"""{bars()} select symbol, bar_ts, {_hours('Asia/Tokyo', 9, 18)} as asian, {LONDON} as london,
  {LONDON} and {_hours('America/New_York', 8, 17)} as ny_overlap,
  {_hours('Europe/London', 16, 17)} as london_close from bars""",
)
def d13(spark, sf):
    return _features(spark, sf, ft.session_masks())


# The second half of the bars' time, and its first half: the third quarter.
MIDDLE = "(select min(bar_ts) + (max(bar_ts) - min(bar_ts)) / 2 from bars)"
THREE_QUARTERS = "(select min(bar_ts) + (max(bar_ts) - min(bar_ts)) * 3 / 4 from bars)"


def _times(bars):
    """Middle and third quarter of the time that the bars cover."""
    lo, hi = bars.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    return lo + (hi - lo) / 2, lo + (hi - lo) * 3 / 4


RANGED = {"atr": ("tr", 1 / 14), "g": (GAIN, 1 / 14), "l": (LOSS, 1 / 14)}


@query(
    "d_feature_range",
    f"""{with_averages(RANGED)}, w as (select *, stddev_pop(close) over {W20} as sd, avg(close) over {W20} as m from a)
  select symbol, bar_ts, {r('atr')} as atr, {r('case when g + l = 0 then 0e0 else (100 * g / (g + l) - 50) / 50 end')} as rsi,
  {r('4 * sd / m')} as bb_width from w where bar_ts >= {MIDDLE} and bar_ts < {THREE_QUARTERS}""",
)
def d_range(spark, sf):
    made = views.bars(spark, sf)
    path = fresh_dir(spark, "ranged")
    files.write_immutable(made, path, "1")
    stored = files.read_store(spark, path, made.schema)
    return ft.features_between(stored, *_times(made), ft.atr(), ft.rsi(), ft.bb_width()).select(
        *KEY, "atr", "rsi", "bb_width"
    )


# Averages that remember far more bars than a tile holds.
LONG = {"ema_fast": ("close", 2 / 13), "ema_slow": ("close", 2 / 4001)}
LONG_OUT = f"symbol, bar_ts, {r('ema_fast')} as ema_fast, {r('ema_slow')} as ema_slow from a"


def _long():
    return [recurrence.average(n, x, a) for n, (x, a) in LONG.items()]


@query("d6_ema_scan", f"{with_averages(LONG)} select {LONG_OUT}")
def d6_scan(spark, sf):
    return recurrence.bar_averages(views.bars(spark, sf), _long(), size=128).select(*KEY, *LONG)


@query("d6_ema_range", f"{with_averages(LONG)} select {LONG_OUT} where bar_ts >= {MIDDLE} and bar_ts < {THREE_QUARTERS}")
def d6_range(spark, sf):
    """A range of the averages from carries kept beside the bars: no bar before the range's chunk is read."""
    made = store(views.bars(spark, sf), "bars")
    carried = store(recurrence.bar_carries(made, _long(), 48), "carries")
    return recurrence.bar_averages_between(made, carried, *_times(made), _long(), 48).select(*KEY, *LONG)


@query(
    "d4_atr_filtered",
    f"""{bars(recursive=True)}, late as (select * from bars where bar_ts >= {MIDDLE}),
  {ROWS.replace('from bars', 'from late')}, {averages('avgs', ATR14)}
  select rows_.symbol, bar_ts, {r('atr')} as atr from rows_ join avgs using (symbol, rn)""",
)
def d4_filtered(spark, sf):
    made = views.bars(spark, sf)
    return ft.compute(made.filter(F.col("bar_ts") >= F.lit(_times(made)[0]).cast("timestamp_ntz")), ft.atr()).select(
        *KEY, "atr"
    )


PAST = OVER.format(50, "1 preceding")


def _scaled(c: str) -> str:
    z = f"({c} - avg({c}) over {PAST}) / nullif(stddev_samp({c}) over {PAST}, 0)"
    return f"case when count({c}) over {PAST} >= 20 then {r(z)} end as {c}_scaled"


@query(
    "d14_causal_scale",
    f"{bars()} select symbol, bar_ts, {_scaled('close')}, {_scaled('volume')} from bars",
)
def d14(spark, sf):
    return _features(spark, sf, ft.causal_scale(("close", "volume")))


@query(
    "d15_windows",
    f"""{bars()}, n as (select *, row_number() over (partition by symbol order by bar_ts) as rn from bars)
  select t.symbol, t.bar_ts, (x.rn - t.rn + 7)::int as pos, x.close as x_close, x.volume as x_volume,
  f.close as y from n t join n f on f.symbol = t.symbol and f.rn = t.rn + 2
  join n x on x.symbol = t.symbol and x.rn between t.rn - 7 and t.rn where t.rn >= 8""",
)
def d15(spark, sf):
    made = samples.windows(views.bars(spark, sf), ["close", "volume"], length=8, horizon=2)
    flat = made.select(*KEY, F.posexplode("x").alias("pos", "row"), "y")
    return flat.select(
        *KEY, "pos", F.col("row.close").alias("x_close"), F.col("row.volume").alias("x_volume"), "y"
    )


AHEAD = """ahead as (select symbol, tf, bar_ts, close as c0,
  lead(open) over w as open, lead(high) over w as high, lead(low) over w as low,
  lead(close) over w as close from bars window w as (partition by symbol order by bar_ts))"""


@query(
    "d16_forward_labels",
    f"""{bars()}, {AHEAD} select symbol, bar_ts, {r(BODY)} as next_body, {r(UPPER)} as next_upper,
  {r(LOWER)} as next_lower, {r('close / c0 - 1')} as next_return, close > c0 as next_up
  from ahead where close is not null""",
)
def d16(spark, sf):
    return samples.forward_labels(views.bars(spark, sf)).drop("tf")


def forecasts_sql(win: int = 100) -> str:
    frame = OVER.format(win, "1 preceding")
    return f"""fc as materialized (select symbol, tf, bar_ts, pc * (1 + q[1]) as q10, pc * (1 + q[2]) as q50,
  pc * (1 + q[3]) as q90, p_bull, greatest(p_bull, 1 - p_bull) as confidence from (select *,
  count(ret) over {frame} as n, avg(case when ret > 0 then 1e0 when ret <= 0 then 0e0 end) over {frame} as p_bull,
  quantile_cont(ret, [0.1, 0.5, 0.9]) over {frame} as q
  from (select *, close / pc - 1 as ret from (select *,
  lag(close) over (partition by symbol order by bar_ts) as pc from bars))) where n >= 20)"""


@query(
    "d17_quantile_baseline",
    f"""{bars()}, {forecasts_sql()} select symbol, bar_ts, {r('q10')} as q10, {r('q50')} as q50,
  {r('q90')} as q90, {r('p_bull')} as p_bull, {r('confidence')} as confidence from fc""",
)
def d17(spark, sf):
    return samples.quantile_baseline(views.bars(spark, sf)).drop("tf")


@query(
    "d18_causality_audit",
    f"""{bars()} select symbol, count(*) as compared, 0::bigint as changed from bars
  where bar_ts < {MIDDLE} group by symbol""",
)
def d18(spark, sf):
    """All features, with the bars cut in the middle of their time."""
    table, audited = views.bars(spark, sf), ft.full_set()
    cols = [o for f in audited for o in f.outputs]
    cut = F.lit(_times(table)[0]).cast("timestamp_ntz")
    return samples.causality_audit(lambda b: ft.compute(b, *audited), table, cut, cols).drop("tf")


@query(
    "d19_stationarity",
    f"""{bars()}, f as (select symbol, close, {BODY} as body_ratio,
  ntile(8) over (partition by symbol order by bar_ts)::int as block from bars)
  select symbol, block, count(*) as n, {r('avg(close)')} as mean_close,
  {r('stddev_samp(close)')} as std_close, {r('avg(body_ratio)')} as mean_body_ratio,
  {r('stddev_samp(body_ratio)')} as std_body_ratio from f group by 1, 2""",
)
def d19(spark, sf):
    table = ft.compute(views.bars(spark, sf), ft.body_ratio())
    return samples.stationarity(table, ["close", "body_ratio"], 8).drop("tf")


@query(
    "d20_latest",
    f"""with {TICKS} select symbol, tick_id, ts, price, spread from (select *, row_number() over
  (partition by symbol order by ts desc, tick_id desc) as rn from ticks) where rn = 1""",
)
def d20(spark, sf):
    return samples.latest(views.ticks(spark, sf), ["symbol"], "ts", "tick_id").select(
        "symbol", "tick_id", "ts", "price", "spread"
    )


@query(
    "d_full_feature_set",
    f"""{with_averages({'atr': ('tr', 1 / 14), 'fast': ('tr', 1 / 5), 'slow': ('tr', 1 / 50),
    'ema': ('close', 2 / 13), 's': ('close', 2 / 27), 'e': ('close', 2 / 21),
    'g': (GAIN, 1 / 14), 'l': (LOSS, 1 / 14)})},
  m as materialized (select *, (ema - s) / close as macd, close / e - 1 as dev from a),
  {averages('sig', {'signal': ('macd', 2 / 10)}, 'm')}
  select symbol, bar_ts, {r(BODY)} as body_ratio, {r(UPPER)} as upper_wick, {r(LOWER)} as lower_wick,
  {r('tr')} as tr, {r('atr')} as atr, {r('(high - low) / nullif(atr, 0)')} as range_to_atr,
  {r('atr / close')} as natr, {r('fast / nullif(slow, 0)')} as vol_expansion, {r('ema')} as ema,
  {r(f'(dev - avg(dev) over {W50}) / nullif(stddev_samp(dev) over {W50}, 0)')} as ema_z,
  {r('case when g + l = 0 then 0e0 else (100 * g / (g + l) - 50) / 50 end')} as rsi,
  {r('macd')} as macd, {r('signal')} as macd_signal, {r('macd - signal')} as macd_hist,
  {r(f'4 * (stddev_pop(close) over {W20}) / (avg(close) over {W20})')} as bb_width,
  {_hours('Asia/Tokyo', 9, 18)} as asian, {LONDON} as london,
  {LONDON} and {_hours('America/New_York', 8, 17)} as ny_overlap,
  {_hours('Europe/London', 16, 17)} as london_close, {_scaled('close')}, {_scaled('volume')}
  from m join sig using (symbol, rn)""",
)
def d_full(spark, sf):
    return _features(spark, sf, *ft.full_set())


@query(
    "e1_align",
    f"""with {TICKS}, {bars_of('M5', 'm5')}, {bars_of('H1', 'h1')}, {bars_of('H4', 'h4')},
  s1 as (select symbol, bar_ts as h1_bar_ts, close as h1_close, volume as h1_volume,
  bar_ts + interval 1 hour as closed from h1),
  s4 as (select symbol, bar_ts as h4_bar_ts, close as h4_close, bar_ts + interval 4 hours as closed from h4),
  f as (select *, bar_ts + interval 5 minutes as decided from m5),
  j as (select f.*, h1_bar_ts, h1_close, h1_volume from f asof left join s1
  on s1.symbol = f.symbol and s1.closed <= f.decided)
  select j.symbol, j.bar_ts, j.close, h1_bar_ts, h1_close, h1_volume::double as h1_volume, h4_bar_ts, h4_close
  from j asof left join s4 on s4.symbol = j.symbol and s4.closed <= j.decided""",
)
def e1(spark, sf):
    fast = views.bars(spark, sf, "M5")
    hour = views.bars(spark, sf, "H1")
    four = bar_ops.resample(hour, "H4", "H1")
    slow = hour.drop("bar_no").unionByName(four)  # one table, two timeframes
    wanted = {"H1": ["close", "volume"], "H4": ["close"]}
    both = joins.align(fast.select(*KEY, "tf", "close"), slow, "M5", wanted)
    return both.drop("tf").withColumn("h1_volume", F.col("h1_volume").cast("double"))


@query(
    "e2_forecast_vs_actual",
    f"""{bars()}, {forecasts_sql()} select symbol, bar_ts, {r('q10')} as q10, {r('q90')} as q90,
  high, low, close, close between q10 and q90 as hit from fc left join (select symbol, bar_ts, high, low, close
  from bars) using (symbol, bar_ts)""",
)
def e2(spark, sf):
    table = views.bars(spark, sf)
    scored = joins.forecast_vs_actual(samples.quantile_baseline(table), table)
    return scored.select(*KEY, "q10", "q90", "high", "low", "close", "hit")


QUIET = "quiet as (select * from ticks where price < 100)"


@query(
    "e6_diff_within",
    f"""with {TICKS}, {QUIET}, {bars_of('H1', 'x')}, {bars_of('H1', 'y', 'quiet')},
  j as (select coalesce(x.symbol, y.symbol) as symbol, coalesce(x.bar_ts, y.bar_ts) as bar_ts,
  x.high as a_high, y.high as b_high, x.close as a_close, y.close as b_close, x.symbol is null as no_a,
  y.symbol is null as no_b from x full join y on x.symbol = y.symbol and x.bar_ts = y.bar_ts),
  d as (select *, case when no_a then 'only_b' when no_b then 'only_a' when abs(a_high - b_high) > 1e-5
  or abs(a_close - b_close) > 1e-5 then 'differs' end as state from j)
  select symbol, bar_ts, a_high, a_close, b_high, b_close, state from d where state is not null""",
)
def e6(spark, sf):
    ticks = views.ticks(spark, sf)
    quiet = bar_ops.to_bars(ticks.filter(F.col("price") < 100), "H1")
    return joins.diff_within(views.bars(spark, sf), quiet, KEY, ["high", "close"], 1e-5)
