"""Ordered work on long series without one task per series.

A symbol may hold a third of all rows, so no window here is partitioned by the
symbol alone. Three ways cover every ordered operator:

* `number` gives each row its position in the series (rows per chunk + a prefix
  sum over the chunk counts);
* `tile` cuts a numbered series into tiles of equal row count and copies to each
  tile the neighbours that its frames need, so bounded frames are exact and all
  features of one tile share a single shuffle;
* `running` evaluates unbounded frames as local scans plus carried chunk totals.

Chunk tables hold one row per (key, chunk), so their windows are bounded by the
calendar span divided by the chunk width, not by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.clock import WIDTHS, col, seconds, slot

TILE = 16_384
# Tasks over which rows without key or time are spread.
STRAYS = 256
SERIES = ("symbol", "tf")
NO = "bar_no"
# Columns by which rows without a position are dealt out.
MARKS = ("symbol", "tf", "bar_ts", "ts", "tick_id")
# The window of `tile_window()` over bars, for expressions written as SQL text.
TILE_OVER = f"OVER (PARTITION BY {', '.join(SERIES)}, _tile ORDER BY {NO})"


@dataclass(frozen=True)
class Scan:
    """One running value: `name` = running `fn` (sum, max, min, last) of `value`."""

    name: str
    fn: str
    value: Column

    def over(self, column: Column, window: WindowSpec) -> Column:
        if self.fn == "last":
            return F.last(column, ignorenulls=True).over(window)
        return getattr(F, self.fn)(column).over(window)

    def total(self, column: Column, order: Column) -> Column:
        if self.fn == "last":
            return F.max_by(column, F.when(column.isNotNull(), order))
        return getattr(F, self.fn)(column)

    def join(self, before: Column, here: Column) -> Column:
        if self.fn == "sum":
            return F.coalesce(before + here, before, here)
        if self.fn == "last":
            return F.coalesce(here, before)
        return (F.greatest if self.fn == "max" else F.least)(before, here)


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _placed(columns: Sequence[str]) -> Column:
    """Every one of the columns is known."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def _aside(order: Sequence[str]) -> Column:
    """Which of many tasks a row without key or time goes to: such rows have no series."""
    return F.lit(1) + F.pmod(F.xxhash64(*order), F.lit(STRAYS)).cast("int")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: Sequence[Scan],
    inclusive: bool = True,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add running values over each key in `order`; `chunk` must not decrease along it.

    Rows are shuffled once by (keys, chunk). The chunk totals read the rows a second
    time, though only keys, order and values, and combine before their shuffle. They
    are taken from `base` if given: a cheaper table with the same values and chunks.

    A row without key or chunk belongs to no series: it passes through with NULL values,
    and such rows are spread over many tasks.
    """
    keys, order = list(keys), list(order)
    own = [*keys, "_chunk"]
    whole = _placed(own)

    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_chunk", chunk)
        return rows.withColumns({f"_v_{s.name}": s.value for s in scans})

    src = prepared(df).withColumn("_stray", F.when(whole, 0).otherwise(_aside(order)))
    totals = prepared(df if base is None else base).filter(whole).groupBy(*own).agg(
        *[s.total(F.col(f"_v_{s.name}"), _order_key(order)).alias(f"_c_{s.name}") for s in scans]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *own,
        F.lit(0).alias("_stray"),
        *[s.over(F.col(f"_c_{s.name}"), before).alias(f"_p_{s.name}") for s in scans],
    )
    here = (
        Window.partitionBy(*own, "_stray")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = src.withColumns({f"_l_{s.name}": s.over(F.col(f"_v_{s.name}"), here) for s in scans})
    joined = local.join(carried, [*own, "_stray"], "left")
    values = {s.name: s.join(F.col(f"_p_{s.name}"), F.col(f"_l_{s.name}")) for s in scans}
    return joined.select(
        *df.columns, *[F.when(F.col("_stray") == 0, v).alias(name) for name, v in values.items()]
    )


def number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    name: str = NO,
) -> DataFrame:
    """Add the 0-based position of each row in its series; NULL without key or chunk."""
    own = [*keys, "_chunk"]
    whole = _placed(own)
    src = df.withColumn("_chunk", chunk)
    src = src.withColumn("_stray", F.when(whole, 0).otherwise(_aside(order)))
    counts = src.filter(whole).groupBy(*own).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *own, F.lit(0).alias("_stray"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    here = Window.partitionBy(*own, "_stray").orderBy(*order)
    return (
        src.withColumn("_rn", F.row_number().over(here))
        .join(offsets, [*own, "_stray"], "left")
        .select(*df.columns, (F.col("_offset") + F.col("_rn") - 1).alias(name))
    )


def bar_chunk(size: int = TILE) -> Column:
    """Chunk of a bar row: `size` slots of its own timeframe, so at most `size` bars."""
    width = F.lit(None).cast("bigint")
    for tf, secs in WIDTHS.items():
        width = F.when(F.col("tf") == tf, F.lit(secs).cast("bigint")).otherwise(width)
    return F.floor(seconds("bar_ts") / (width * size))


def number_bars(bars: DataFrame) -> DataFrame:
    """Bars with their position; a stored `bar_no` is used as it is."""
    if NO in bars.columns:
        return bars
    return number(bars, SERIES, ["bar_ts"], bar_chunk())


def number_ticks(ticks: DataFrame, grain: int = 60) -> DataFrame:
    """Ticks with their position per symbol, in (ts, tick_id) order."""
    if NO in ticks.columns:
        return ticks
    return number(ticks, ["symbol"], ["ts", "tick_id"], slot("ts", grain))


def tile(
    df: DataFrame, before: int = 0, after: int = 0, size: int = TILE, no: str = NO
) -> DataFrame:
    """Add `_tile`; copy each row also to the tiles whose frames reach it.

    A tile sees `before` rows ahead of its first row and `after` rows past its last. Rows
    without a position get tiles below zero, spread over many tasks.
    """
    # Few columns, so that a scan still reads no more than the frames use.
    aside = -_aside([c for c in MARKS if c in df.columns] or [no]).cast("bigint")
    if before == 0 and after == 0:
        return df.withColumn("_tile", F.coalesce(F.floor(F.col(no) / size), aside))
    first = F.greatest(F.floor((F.col(no) - after) / size), F.lit(0).cast("bigint"))
    last = F.floor((F.col(no) + before) / size)
    reached = F.when(F.col(no).isNull(), F.array(aside)).otherwise(F.sequence(first, last))
    return df.withColumn("_tile", F.explode(reached))


def core(df: DataFrame, size: int = TILE, no: str = NO) -> DataFrame:
    """Drop the copied rows again."""
    own = F.col("_tile") == F.floor(F.col(no) / size)
    return df.filter(own | (F.col("_tile") < 0)).drop("_tile")


def tile_window(keys: Sequence[str] = SERIES, no: str = NO) -> WindowSpec:
    return Window.partitionBy(*keys, "_tile").orderBy(no)


def tiled(
    df: DataFrame,
    compute,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = SERIES,
    size: int = TILE,
    no: str = NO,
) -> DataFrame:
    """Run `compute(df, window)` on tiles; frames must stay inside [-before, after].

    What it says of rows without a position (`no` is NULL) has no meaning.
    """
    return core(compute(tile(df, before, after, size, no), tile_window(keys, no)), size, no)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    grain: int,
    right_order: Sequence[str] = (),
) -> DataFrame:
    """Attach to each left row the last right row with right_ts <= left_ts."""
    return asof_all(left, [(right, right_ts, cols)], keys, left_ts, grain, right_order)


def asof_all(
    left: DataFrame,
    rights: Sequence[tuple[DataFrame, str, Sequence[str]]],
    keys: Sequence[str],
    left_ts: str,
    grain: int,
    right_order: Sequence[str] = (),
) -> DataFrame:
    """Attach to each left row the last row of each right table, (table, time, columns).

    All sides are merged into one time line and the last rows of each table are carried
    forward, chunk by chunk of `grain` seconds, so no key is one task and further tables
    cost no further pass. `right_order` settles equal times within a table.
    """
    keys = list(keys)
    marks = [f"_o{i}" for i in range(len(right_order))]
    kinds = {
        f"_right{i}": df.select(F.struct(*cols).alias("p")).schema["p"].dataType
        for i, (df, _, cols) in enumerate(rights)
    }
    order_kinds = [rights[0][0].schema[c].dataType for c in right_order]

    def empty(names: Sequence[str]) -> list[Column]:
        return [F.lit(None).cast(kinds[n]).alias(n) for n in names]

    l_side = left.select(
        *keys,
        F.col(left_ts).alias("_at"),
        F.lit(1).alias("_side"),
        *[F.lit(None).cast(t).alias(m) for t, m in zip(order_kinds, marks)],
        F.struct(*left.columns).alias("_left"),
        *empty(list(kinds)),
    )
    line, r_sides = l_side, []
    for i, (df, ts, cols) in enumerate(rights):
        own = f"_right{i}"
        r_side = df.select(
            *keys,
            F.col(ts).alias("_at"),
            F.lit(0).alias("_side"),
            *[F.col(c).alias(m) for c, m in zip(right_order, marks)],
            F.lit(None).cast(l_side.schema["_left"].dataType).alias("_left"),
            F.struct(*cols).alias(own),
            *empty([n for n in kinds if n != own]),
        )
        line = line.unionByName(r_side)
        r_sides.append(r_side.drop("_left"))
    # The totals need the right rows, and of the left only which chunks it has.
    start = F.timestamp_seconds(slot("_at", grain) * grain).cast("timestamp_ntz")
    base = l_side.select(*keys, start.alias("_at"), "_side", *marks, *kinds).distinct()
    for r_side in r_sides:
        base = base.unionByName(r_side)
    scans = [Scan(n.replace("right", "match"), "last", col(n)) for n in kinds]
    scanned = running(line, keys, ["_at", "_side", *marks], slot("_at", grain), scans, base=base)
    matches = [
        F.col(f"_match{i}.{c}").alias(c) for i, (_, _, cols) in enumerate(rights) for c in cols
    ]
    return scanned.filter(F.col("_side") == 1).select("_left.*", *matches)
