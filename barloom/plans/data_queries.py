"""Sources, cleaning, health checks, bars."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import clock
from barloom.operators import bars as bar_ops
from barloom.operators import features as ft
from barloom.operators import quality as q
from barloom.operators import slices as sl
from barloom.operators.metrics import feature_stats
from barloom.plans.oracle import K, TICKS, bars, bars_of, r
from barloom.plans.registry import query
from barloom.session import fresh_dir, store
from barloom.sources import files, views

ARRIVAL = ["arrived_at", "tick_id"]
MID_LO, MID_HI = "2024-01-16 00:00:00", "2024-01-16 12:30:00"


def arrival_chunk():
    return clock.slot("arrived_at", 60)


@query("a1_read_ticks", f"with {TICKS} select tick_id, symbol, ts, price, spread from ticks")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "landed")
    views.ticks(spark, sf).write.parquet(path)
    return files.read_ticks(spark, path)


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return views.ticks(spark, sf).select("symbol").distinct()


SLICES = """span as (select date_trunc('day', min(ts)) as lo, date_trunc('day', max(ts)) + interval 1 day as hi from events),
  slices as (select symbol, lo, least(lo + interval 7 days, stop) as hi from (select symbol, span.hi as stop,
  unnest(generate_series(span.lo::timestamp, span.hi::timestamp, interval 7 days)) as lo
  from (select distinct event_type as symbol from events), span) where lo < stop)"""


def _slices(spark, sf):
    """Weeks over the days that the ticks cover."""
    lo, hi = views.ticks(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    start, last = (datetime(t.year, t.month, t.day) for t in (lo, hi))
    return sl.plan_slices(_symbols(spark, sf), start, last + timedelta(days=1), "7 days")


@query("a2_plan_slices", f"with {SLICES} select symbol, lo, hi from slices")
def a2(spark, sf):
    return _slices(spark, sf)


@query(
    "a3_slice_coverage",
    f"""{bars()}, {SLICES} select s.symbol, s.lo, s.hi, count(b.bar_ts) as n,
  count(b.bar_ts) = 0 as is_empty, count(b.bar_ts) >= 150 as at_cap from slices s left join bars b
  on b.symbol = s.symbol and b.bar_ts >= s.lo and b.bar_ts < s.hi group by 1, 2, 3""",
)
def a3(spark, sf):
    return sl.slice_coverage(_slices(spark, sf), views.bars(spark, sf), 150, "H1")


@query(
    "a4_union_slices",
    f"""with {TICKS}, first_ticks as (select * from ticks where ts < timestamp '{MID_HI}'),
  last_ticks as (select * from ticks where ts >= timestamp '{MID_LO}'),
  {bars_of('H1', 'b1', 'first_ticks')}, {bars_of('H1', 'b2', 'last_ticks')},
  merged as (select *, row_number() over (partition by symbol, tf, bar_ts order by part desc) as rn
  from (select *, 0 as part from b1 union all select *, 1 as part from b2))
  select symbol, tf, bar_ts, open, high, low, close, volume from merged where rn = 1""",
)
def a4(spark, sf):
    ticks = views.ticks(spark, sf)
    first = bar_ops.to_bars(ticks.filter(F.col("ts") < F.lit(MID_HI).cast("timestamp_ntz")), "H1")
    last = bar_ops.to_bars(ticks.filter(F.col("ts") >= F.lit(MID_LO).cast("timestamp_ntz")), "H1")
    return sl.union_slices(first, last).drop("spread")


@query(
    "a5_write_immutable",
    f"""{bars()}, {bars_of('M5', 'm5')}, {bars_of('H4', 'h4')}
  select 'first' as batch, symbol, tf, bar_ts, open, high, low, close, volume, spread from bars
  union all by name select 'first' as batch, * from m5 union all by name select 'second' as batch, * from h4""",
)
def a5(spark, sf):
    path = fresh_dir(spark, "store")
    both = mixed_bars(spark, sf)
    files.write_immutable(both, path, "first")
    files.write_immutable(bar_ops.to_bars(views.ticks(spark, sf), "H4"), path, "second")
    return files.read_store(spark, path, schemas.BARS).select("batch", *schemas.BARS.names)


@query(
    "a5_store_slices",
    f"""{bars()}, {bars_of('M5', 'm5')}, {bars_of('H4', 'h4')}, stored as (
  select 'first' as batch, symbol, tf, bar_ts from bars union all by name select 'first' as batch, symbol, tf, bar_ts from m5
  union all by name select 'second' as batch, symbol, tf, bar_ts from h4)
  select batch, symbol, tf, year(bar_ts)::int as year, min(bar_ts) as first_ts, max(bar_ts) as last_ts, count(*) as rows
  from stored group by all""",
)
def a5_slices(spark, sf):
    """The manifest after two batches and a third, which is refused: its slice is there already."""
    path = fresh_dir(spark, "store")
    files.write_immutable(mixed_bars(spark, sf), path, "first")
    files.write_immutable(bar_ops.to_bars(views.ticks(spark, sf), "H4"), path, "second")
    try:
        files.write_immutable(mixed_bars(spark, sf).filter("tf = 'H1'"), path, "third")
    except ValueError:
        return files.slices(spark, path)
    raise AssertionError("the store took a slice twice")


def mixed_bars(spark, sf):
    """M5 and H1 bars in one table."""
    return views.bars(spark, sf).unionByName(views.bars(spark, sf, "M5")).drop("bar_no")


@query(
    "a6_sql_layer",
    f"""{bars()} select symbol, cast(cast(bar_ts as date) as varchar) as day, max(high) - min(low) as day_range,
  sum(volume)::bigint as volume from bars group by 1, 2 having count(*) >= 2""".replace(
        "max(high) - min(low)", r("max(high) - min(low)")
    ),
)
def a6(spark, sf):
    files.register(spark, {"bars": views.bars(spark, sf)})
    return spark.sql(
        """select symbol, cast(cast(bar_ts as date) as string) as day, max(high) - min(low) as day_range,
        sum(volume) as volume from bars group by 1, 2 having count(*) >= 2"""
    )


@query(
    "a9_feature_stats",
    f"""{bars()}, f as (select symbol, tf, bar_ts, case when high = low then 0 else
  abs(close - open) / (high - low) end as body_ratio, volume::double as volume, close from bars),
  u as (unpivot (select body_ratio, volume, close from f) on body_ratio, volume, close
  into name feature value v)
  select feature, case feature when 'body_ratio' then 0 when 'volume' then 1 else 2 end as idx,
  case feature when 'volume' then 'bigint' else 'double' end as dtype,
  {r('avg(v)')} as mean, {r('stddev_samp(v)')} as std, count(v) as n from u group by 1""",
)
def a9(spark, sf):
    table = ft.compute(views.bars(spark, sf), ft.body_ratio())
    return feature_stats(table, ["body_ratio", "volume", "close"])


@query(
    "b1_dedupe",
    f"""with {TICKS} select tick_id, symbol, hour, ts, price from (select *,
  row_number() over (partition by symbol, hour order by ts desc, tick_id desc) as rn
  from (select *, date_trunc('hour', ts) as hour from ticks)) where rn = 1""",
)
def b1(spark, sf):
    hour = F.window("ts", "1 hour").start
    ticks = views.ticks(spark, sf).withColumn("hour", hour)
    kept = q.dedupe(ticks, ["symbol", "hour"], [F.col("ts").desc(), F.col("tick_id").desc()])
    return kept.select("tick_id", "symbol", "hour", "ts", "price")


@query(
    "b2_sort_utc",
    f"""with {TICKS} select tick_id, symbol,
  timezone('UTC', timezone('America/New_York', ts)) as ts from ticks""",
)
def b2(spark, sf):
    return q.sort_utc(views.ticks(spark, sf), "ts", "America/New_York").select("tick_id", "symbol", "ts")


def local(ts: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


def open_sql(ts: str) -> str:
    at = local(ts, "America/New_York")
    return f"""not (dayofweek({at}) = 6 or (dayofweek({at}) = 5 and hour({at}) >= 17)
  or (dayofweek({at}) = 0 and hour({at}) < 17))"""


@query("b3_market_open", f"with {TICKS} select tick_id, ts, {open_sql('ts')} as is_open from ticks")
def b3(spark, sf):
    return views.ticks(spark, sf).select("tick_id", "ts", clock.market_open("ts").alias("is_open"))


@query(
    "b4_find_gaps",
    f"""{bars()}, p as (select symbol, bar_ts as gap_start,
  lead(bar_ts) over (partition by symbol order by bar_ts) as gap_end from bars),
  s as (select symbol, gap_start, gap_end, unnest(generate_series(gap_start + interval 1 hour,
  gap_end - interval 1 hour, interval 1 hour)) as slot_ts from p where gap_end > gap_start + interval 1 hour)
  select symbol, gap_start, gap_end, count(*) as missing from s where {open_sql('slot_ts')} group by 1, 2, 3""",
)
def b4(spark, sf):
    return q.find_gaps(mixed_bars(spark, sf), "H1")


@query(
    "b5_missing_slots",
    f"""{bars()}, g as (select symbol, unnest(generate_series(min(bar_ts), max(bar_ts),
  interval 1 hour)) as bar_ts from bars group by symbol)
  select g.symbol, g.bar_ts from g anti join bars b on b.symbol = g.symbol and b.bar_ts = g.bar_ts
  where {open_sql('g.bar_ts')}""",
)
def b5(spark, sf):
    return q.missing_slots(mixed_bars(spark, sf), "H1")


@query("b6_check_price", f"with {TICKS} select tick_id, symbol, price, price <= 0 as bad from ticks")
def b6(spark, sf):
    return views.ticks(spark, sf).select("tick_id", "symbol", "price", q.chk_price("price").alias("bad"))


MEDIAN = """m as (select *, quantile_cont(spread, 0.5) over (partition by symbol order by ts, tick_id
  rows between 50 preceding and 1 preceding) as spread_median from ticks)"""
BAD_SPREAD = "(spread <= 0 or coalesce(spread > 3 * spread_median, false))"


@query(
    "b7_check_spread",
    f"""with {TICKS}, {MEDIAN} select tick_id, symbol, spread,
  round(spread_median * 2e6) as twice_median_points, {BAD_SPREAD} as bad from m""",
)
def b7(spark, sf):
    rolled = q.spread_median(views.ticks(spark, sf), 50)
    bad = q.chk_spread("spread", "spread_median", 3.0).alias("bad")
    # The median of an even count has one digit more than the spreads; kept whole here.
    points = F.round(F.col("spread_median") * 2e6).alias("twice_median_points")
    return rolled.select("tick_id", "symbol", "spread", points, bad)


NEWEST = """(select *, max(ts) over (partition by symbol order by arrived_at, tick_id
  rows between unbounded preceding and 1 preceding) as newest from {})"""


@query(
    "b8_check_order",
    f"""with {TICKS} select tick_id, symbol, ts, coalesce(ts < newest, false) as bad
  from {NEWEST.format('ticks')}""",
)
def b8(spark, sf):
    seen = q.newest_before(views.arrivals(spark, sf), ARRIVAL, arrival_chunk())
    return seen.select("tick_id", "symbol", "ts", q.chk_order("ts", "newest").alias("bad"))


@query(
    "b9_check_ohlc",
    f"""{bars()}, bid as (select * replace (round(high - spread, 6) as high) from bars)
  select symbol, bar_ts, {r('high')} as high, low <= least(open, close) and high >= greatest(open, close)
  as consistent from bid""",
)
def b9(spark, sf):
    bid = views.bars(spark, sf).withColumn("high", F.round(F.col("high") - F.col("spread"), 6))
    return bid.select("symbol", "bar_ts", "high", (~q.chk_ohlc()).alias("consistent"))


CHECKED = f"""with {TICKS}, {MEDIAN}, c as (select *, price <= 0 as bad_price, {BAD_SPREAD} as bad_spread,
  coalesce(ts < newest, false) as bad_order from {NEWEST.format('m')})"""


def _checked(spark, sf):
    return q.checked_ticks(views.arrivals(spark, sf), ARRIVAL, arrival_chunk(), n=50, k=3.0)


DIRTY = f"""dirty as (select event_id as tick_id, case when event_id % 97 = 0 then null else event_type end as symbol,
  case when event_id % 89 = 0 then null else ts end as ts,
  case when event_id % 83 = 0 then 'nan'::double when event_id % 79 = 0 then null
    when event_id % 71 = 0 then 'inf'::double else value end as price,
  case when event_id % 73 = 0 then 'nan'::double when event_id % 67 = 0 then null
    else round(value * {K} / 10000e0, 6) end as spread, ts + to_minutes({K}) as arrived_at from events),
  dm as (select *, case when symbol is not null and ts is not null then
    quantile_cont(case when isnan(spread) then null else spread end, 0.5) over (
      partition by symbol, ts is null order by ts, tick_id rows between 50 preceding and 1 preceding) end as spread_median,
    case when symbol is not null then max(ts) over (partition by symbol order by arrived_at, tick_id
      rows between unbounded preceding and 1 preceding) end as newest from dirty),
  dc as (select *, symbol is null or ts is null as bad_key,
    price is null or isnan(price) or isinf(price) or price <= 0 as bad_price,
    spread is null or isnan(spread) or isinf(spread) or spread <= 0
      or coalesce(spread > 3 * spread_median, false) as bad_spread,
    coalesce(ts < newest, false) as bad_order from dm)"""


def dirty_ticks(spark, sf):
    """The ticks with unknown keys, times, prices and spreads, NaN and infinity planted."""

    def planted(column, *cases):
        c = F.col(column)
        for every, value in cases:
            c = F.when(F.col("tick_id") % every == 0, F.lit(value).cast("double")).otherwise(c)
        return c

    ticks = views.arrivals(spark, sf)
    return ticks.withColumns(
        {
            "symbol": F.when(F.col("tick_id") % 97 != 0, F.col("symbol")),
            "ts": F.when(F.col("tick_id") % 89 != 0, F.col("ts")),
            "price": planted("price", (71, float("inf")), (79, None), (83, float("nan"))),
            "spread": planted("spread", (67, None), (73, float("nan"))),
        }
    )


def _checked_dirty(spark, sf):
    return store(q.checked_ticks(dirty_ticks(spark, sf), ARRIVAL, arrival_chunk(), n=50, k=3.0), "validated")


@query(
    "b10_validate_dirty",
    f"""with {DIRTY} select tick_id, symbol, coalesce(array_to_string(list_filter([
  case when bad_key then 'key' end, case when bad_price then 'price' end, case when bad_spread then 'spread' end,
  case when bad_order then 'order' end], lambda x: x is not null), ','), '') as violations from dc""",
)
def b10_dirty(spark, sf):
    clean, bad = q.split(_checked_dirty(spark, sf))
    both = clean.withColumn("violations", F.array().cast("array<string>")).unionByName(bad)
    return both.select("tick_id", "symbol", F.array_join("violations", ",").alias("violations"))


@query(
    "b11_health_report_dirty",
    f"""with {DIRTY}, d as (select *, strftime(ts, '%Y-%m-%d') as day from dc)
  select symbol, day, grouping_id(symbol, day)::int as level, count(*) as n,
  count(*) filter (bad_key or bad_price or bad_spread or bad_order) as bad, count(*) filter (bad_key) as bad_key,
  count(*) filter (bad_price) as bad_price, count(*) filter (bad_spread) as bad_spread,
  count(*) filter (bad_order) as bad_order from d group by rollup (symbol, day)""",
)
def b11_dirty(spark, sf):
    checked = _checked_dirty(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return q.health_report(checked, ["key", "price", "spread", "order"], by=["symbol", "day"])


@query(
    "b6_check_price_dirty",
    f"""with {DIRTY} select tick_id, symbol, bad_price as bad from dc""",
)
def b6_dirty(spark, sf):
    return dirty_ticks(spark, sf).select("tick_id", "symbol", q.chk_price("price").alias("bad"))


@query(
    "b10_validate",
    f"""{CHECKED} select tick_id, symbol, coalesce(array_to_string(list_filter([
  case when bad_price then 'price' end, case when bad_spread then 'spread' end,
  case when bad_order then 'order' end], lambda x: x is not null), ','), '') as violations from c""",
)
def b10(spark, sf):
    clean, bad = q.split(store(_checked(spark, sf), "validated"))  # two readers, one computation
    both = clean.withColumn("violations", F.array().cast("array<string>")).unionByName(bad)
    return both.select("tick_id", "symbol", F.array_join("violations", ",").alias("violations"))


@query(
    "b11_health_report",
    f"""{CHECKED}, d as (select *, strftime(ts, '%Y-%m-%d') as day from c)
  select symbol, day, grouping_id(symbol, day)::int as level, count(*) as n,
  count(*) filter (bad_price or bad_spread or bad_order) as bad,
  count(*) filter (bad_price) as bad_price, count(*) filter (bad_spread) as bad_spread,
  count(*) filter (bad_order) as bad_order from d group by rollup (symbol, day)""",
)
def b11(spark, sf):
    checked = _checked(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return q.health_report(checked, ["price", "spread", "order"], by=["symbol", "day"])


BAR_COLS = "symbol, tf, bar_ts, open, high, low, close, volume, spread"


@query("c1_to_bars", f"{bars('M5')} select {BAR_COLS} from bars")
def c1(spark, sf):
    return bar_ops.to_bars(views.ticks(spark, sf), "M5")


@query("c2_resample", f"{bars('H4')} select {BAR_COLS} from bars")
def c2(spark, sf):
    return bar_ops.resample(mixed_bars(spark, sf), "H4", "H1")
