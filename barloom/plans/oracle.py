"""Fragments of the DuckDB statements: the market views and recursive averages."""

from __future__ import annotations

from barloom.functions.clock import WIDTHS

K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

TICKS = f"""ticks as (select event_id as tick_id, event_type as symbol, ts, value as price,
  round(value * {K} / 10000e0, 6) as spread, ts + to_minutes({K}) as arrived_at from events)"""

TRADES = f"""trades as (select event_id as trade_id, user_id % 10 as account_id,
  user_id % 4 as strategy_id, event_type as symbol, ts as open_ts, ts + to_minutes({K}) as close_ts,
  round(value - 49.63e0, 2) as pnl from events)"""

POSITIONS = f"""positions as (select event_id as ticket, user_id as account_id, event_type as symbol,
  case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, {K} / 100e0 as volume,
  value as entry from events)"""

ORDER_EVENTS = """order_events as (select event_id, user_id as order_id, ts,
  case event_type when 'signup' then 'PLACE' when 'purchase' then 'FILL' when 'click' then 'CANCEL'
  when 'error' then 'REJECT' else 'QUOTE' end as kind from events)"""


def r(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def bars_of(tf: str, name: str = "bars", source: str = "ticks") -> str:
    return f"""{name} as materialized (select symbol, '{tf}' as tf,
  time_bucket(interval '{WIDTHS[tf]} seconds', ts) as bar_ts, arg_min(price, (ts, tick_id)) as open,
  max(price) as high, min(price) as low, arg_max(price, (ts, tick_id)) as close, count(*) as volume,
  arg_max(spread, (ts, tick_id)) as spread from {source} group by 1, 2, 3)"""


def bars(tf: str = "H1", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{TICKS}, {bars_of(tf)}"


# Bars with position, previous close and true range.
ROWS = """rows_ as materialized (select *, greatest(high - low, coalesce(abs(high - pc), 0),
  coalesce(abs(low - pc), 0)) as tr from (select *,
  row_number() over (partition by symbol order by bar_ts) as rn,
  lag(close) over (partition by symbol order by bar_ts) as pc from bars))"""


def averages(name: str, specs: dict[str, tuple[str, float]], source: str = "rows_") -> str:
    """Recursive averages of expressions over `source`, as table `name`(symbol, rn, ...)."""
    first = ", ".join(f"{x} as {out}" for out, (x, _) in specs.items())
    step = ", ".join(
        f"p.{out} + {a!r}e0 * (n.{out}_x - p.{out}) as {out}" for out, (_, a) in specs.items()
    )
    inputs = ", ".join(f"{x} as {out}_x" for out, (x, _) in specs.items())
    return f"""{name}_in as materialized (select symbol, rn, {inputs} from {source}),
  {name} as (select symbol, rn, {first} from {source} where rn = 1 union all
  select n.symbol, n.rn, {step} from {name} p join {name}_in n
  on n.symbol = p.symbol and n.rn = p.rn + 1)"""


def with_averages(specs: dict[str, tuple[str, float]], tf: str = "H1") -> str:
    """Statement head that offers `a`: the rows of ROWS joined with the averages."""
    return f"""{bars(tf, recursive=True)}, {ROWS}, {averages('avgs', specs)},
  a as (select rows_.*, avgs.* exclude (symbol, rn) from rows_ join avgs using (symbol, rn))"""
