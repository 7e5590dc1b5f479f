"""Linear recurrences x[t] = a[t] * x[t-1] + b[t] over long series, as scans of associative pairs.

Two steps (a, b) and then (c, d) are one step (c * a, c * b + d). So a chunk of a series is one step as well:
chunks are summed up apart, the few chunk steps are chained per series, and each chunk starts from what was
carried to it. Rows meet their chunk's carry without copies of the rows before the chunk, however far the
recurrence remembers. Carries kept beside a store let a range be answered from its own chunks alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.clock import WIDTHS
from barloom.operators.tiles import SERIES, bar_chunk
from barloom.session import store

#: Slots of the timeframe in a chunk of bars.
CHUNK = 4096


@dataclass(frozen=True)
class Recurrence:
    """x[t] = a * x[t-1] + b, and `first` for the first row of a series.

    A row whose a, b or first is unknown (NULL or not a number) leaves the value as it is; before the
    first known row there is none.
    """

    name: str
    a: Column
    b: Column
    first: Column


def average(name: str, column: str, alpha: float) -> Recurrence:
    """Exponential average of a column, seeded by its first value."""
    x = F.col(column)
    return Recurrence(name, F.lit(1 - alpha), F.lit(alpha) * x, x)


def prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps 0..t as one step, for every t: spans of doubling length are joined."""
    a, b, span = a.copy(), b.copy(), 1
    while span < len(a):
        b[span:] = a[span:] * b[:-span] + b[span:]
        a[span:] = a[span:] * a[:-span]
        span *= 2
    return a, b


def _sorted_steps(table, i: int):
    """Sorted rows' known flags, and their steps alone (a, b) and seeded by the first known row (sa, sb)."""
    a, b, first = (table.column(f"_{p}{i}").to_numpy().astype(float) for p in "abf")
    known = np.isfinite(a) & np.isfinite(b) & np.isfinite(first)
    a, b = np.where(known, a, 1.0), np.where(known, b, 0.0)
    sa, sb = a.copy(), b.copy()
    if known.any():
        at = int(known.argmax())
        sa[at], sb[at] = 0.0, first[at]
    return known, (a, b), (sa, sb)


def _prepared(df: DataFrame, keys: Sequence[str], chunk: Column, steps: Sequence[Recurrence]) -> DataFrame:
    parts = {f"_{p}{i}": c.cast("double") for i, s in enumerate(steps) for p, c in zip("abf", (s.a, s.b, s.first), strict=True)}
    return df.withColumn("_chunk", chunk).withColumns(parts)


def _placed(keys: Sequence[str], order: Sequence[str]) -> Column:
    ok = F.col("_chunk").isNotNull()
    for c in (*keys, *order):
        ok = ok & F.col(c).isNotNull()
    return ok


def carries(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, steps: Sequence[Recurrence]
) -> DataFrame:
    """keys, _chunk and the value of each recurrence just before the chunk, NULL where there is none yet.

    A row per key and chunk. Only keys, order and steps of the rows are read; a task sums up a chunk, and
    the chunks of a key, bounded by the calendar, are chained by one task.
    """
    keys, order, count = list(keys), list(order), len(steps)  # tasks take no Column with them
    made = _prepared(df, keys, chunk, steps)
    made = made.filter(_placed(keys, order)).select(*keys, "_chunk", *order, *[f"_{p}{i}" for i in range(count) for p in "abf"])
    named = [made.schema[k] for k in keys] + [made.schema["_chunk"]]
    doubles = [T.StructField(f"_{p}{i}", T.DoubleType()) for i in range(count) for p in "abs"]
    total_schema = T.StructType([*named, *doubles])
    carry_schema = T.StructType([*named, *[T.StructField(s.name, T.DoubleType()) for s in steps]])
    marks = [(c, "ascending") for c in order]

    def sum_up(table):
        import pyarrow as pa

        table, out = table.sort_by(marks), []
        for i in range(count):
            known, alone, seeded = _sorted_steps(table, i)
            (a, b), (_, s) = prefixes(*alone), prefixes(*seeded)
            out += [pa.array([a[-1]]), pa.array([b[-1]]), pa.array([s[-1] if known.any() else None], pa.float64())]
        first = [table.column(f.name).combine_chunks().slice(0, 1) for f in named]
        return pa.Table.from_arrays([*first, *out], total_schema.names)

    def chain(table):
        import pyarrow as pa

        table, out = table.sort_by("_chunk"), []
        for i in range(count):
            value, held = None, []
            for a, b, s in zip(*(table.column(f"_{p}{i}").to_pylist() for p in "abs"), strict=True):
                held.append(value)
                value = s if value is None else a * value + b
            out.append(pa.array(held, pa.float64()))
        return pa.Table.from_arrays([*[table.column(f.name) for f in named], *out], carry_schema.names)

    totals = made.groupBy(*keys, "_chunk").applyInArrow(sum_up, total_schema)
    return totals.groupBy(*keys).applyInArrow(chain, carry_schema)


def recur(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    steps: Sequence[Recurrence],
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add the values of the recurrences to the rows; `chunk` must not decrease along `order`.

    `carried` is what `carries` found, from a store if it is kept there; else it is computed. Rows
    without key, order or chunk belong to no series and have NULL values.
    """
    keys, order, count = list(keys), list(order), len(steps)  # tasks take no Column with them
    if carried is None:
        carried = store(carries(df, keys, order, chunk, steps), "recurrence-carries")
    names = [s.name for s in steps]
    own = [c for c in df.columns if c not in names]
    held = carried.select(*keys, "_chunk", *[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)])
    made = _prepared(df, keys, chunk, steps)
    inside = _placed(keys, order)
    rows = made.filter(inside).join(held, [*keys, "_chunk"], "left")
    kept = [df.schema[c] for c in own]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])
    marks = [(c, "ascending") for c in order]

    def apply(table):
        import pyarrow as pa

        table, out = table.sort_by(marks), []
        for i in range(count):
            known, alone, seeded = _sorted_steps(table, i)
            carry = table.column(f"_c{i}")[0].as_py()
            if carry is None:
                _, x = prefixes(*seeded)
                out.append(pa.array(x, mask=~np.maximum.accumulate(known)))
            else:
                a, b = prefixes(*alone)
                out.append(pa.array(a * carry + b))
        return pa.Table.from_arrays([*[table.column(f.name) for f in kept], *out], schema.names)

    found = rows.groupBy(*keys, "_chunk").applyInArrow(apply, schema)
    none = [F.lit(None).cast("double").alias(n) for n in names]
    return found.unionByName(made.filter(~F.coalesce(inside, F.lit(False))).select(*own, *none))


def bar_averages(bars: DataFrame, steps: Sequence[Recurrence], size: int = CHUNK, carried: DataFrame | None = None) -> DataFrame:
    return recur(bars, SERIES, ["bar_ts"], bar_chunk(size), steps, carried)


def bar_carries(bars: DataFrame, steps: Sequence[Recurrence], size: int = CHUNK) -> DataFrame:
    """The carries of a store of bars, to be kept beside it; a row per `size` slots of a series."""
    return carries(bars, SERIES, ["bar_ts"], bar_chunk(size), steps)


def bar_averages_between(
    bars: DataFrame, carried: DataFrame, start: datetime, end: datetime, steps: Sequence[Recurrence], size: int = CHUNK
) -> DataFrame:
    """The recurrences of the bars with start <= bar_ts < end, from the chunks of the range alone.

    `carried` are the `bar_carries` of the whole store. No bar is read before the chunk that `start`
    lies in, whatever the recurrences remember. A chunk without a carry begins its series. The steps must
    follow from the row alone, since the bar before a chunk is not read.
    """
    second = int(start.replace(tzinfo=timezone.utc).timestamp())

    def begin(width: int) -> datetime:
        return datetime(1970, 1, 1) + timedelta(seconds=second - second % (width * size))

    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    since = F.lit(False)
    for tf, width in WIDTHS.items():
        since = since | ((F.col("tf") == tf) & (F.col("bar_ts") >= lit(begin(width))))
    first = min(begin(width) for width in WIDTHS.values())  # the reach of the widest timeframe, for the scan
    rows = bars.filter((F.col("bar_ts") >= lit(first)) & (F.col("bar_ts") < lit(end)) & since)
    return bar_averages(rows, steps, size, carried).filter(F.col("bar_ts") >= lit(start))
