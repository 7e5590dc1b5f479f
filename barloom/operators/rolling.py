"""Quantiles of sliding frames, kept in order while they slide."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.sqlmath import sorted_quantile

#: Frames of up to so many rows are collected and sorted again for each row, which Spark does as fast itself.
SHORT = 64


def _places(size: int, quantiles: Sequence[float]) -> list[tuple[int, int, float]]:
    """Of each quantile of so many sorted values: the two places it lies between, and how far along."""
    at = [(size - 1) * q for q in quantiles]
    return [(int(p), -int(-p // 1), p - int(p)) for p in at]


def slide(values: Sequence[float | None], n: int, quantiles: Sequence[float]) -> tuple[list[int], list[list[float | None]]]:
    """Of the `n` values before each: how many are known, and their quantiles, interpolated linearly.

    The frame is a sorted list: a step finds two places by bisection. NaN is above every number.
    """
    held, unordered, known, out, cut = [], 0, [], [[] for _ in quantiles], {}
    nan = float("nan")
    for t, value in enumerate(values):
        size = len(held) + unordered
        known.append(size)
        if size:
            if size not in cut:
                cut[size] = _places(size, quantiles)
            for found, (low, high, part) in zip(out, cut[size]):
                if high < len(held):
                    found.append(held[low] + (held[high] - held[low]) * part)
                else:
                    found.append(nan)
        else:
            for found in out:
                found.append(None)
        if value is not None:
            if value == value:
                insort(held, value)
            else:
                unordered += 1
        if t >= n and (gone := values[t - n]) is not None:
            if gone == gone:
                del held[bisect_left(held, gone)]
            else:
                unordered -= 1
    return known, out


def quantiles_before(
    tiled: DataFrame, w: WindowSpec, groups: Sequence[str], no: str, value: str, n: int,
    quantiles: Mapping[str, float], count: str,
) -> DataFrame:
    """Add the quantiles of `value` over the `n` rows before each row of its tile, and the `count` of known ones.

    `tiled` has tiles that see `n` rows ahead (`tiles.tile`) and `w` is their window by `groups` and `no`; frames
    of copied rows reach out of the tile and mean nothing. NULLs do not count, an empty frame has NULL
    quantiles, and so have rows without a position. The cost of a row does not grow with `n`.
    """
    placed = F.col(no).isNotNull()
    if n <= SHORT:
        recent = F.sort_array(F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-n, -1)))
        made = tiled.withColumn("_recent", F.when(placed, recent))
        found = {name: sorted_quantile("_recent", q) for name, q in quantiles.items()}
        number = F.when(placed, F.size("_recent").cast("long"))
        return made.withColumns({**found, count: number}).drop("_recent")
    return _slid(tiled, groups, no, value, n, quantiles, count)


def _slid(
    tiled: DataFrame, groups: Sequence[str], no: str, value: str, n: int, quantiles: Mapping[str, float], count: str
) -> DataFrame:
    """`quantiles_before` by frames that stay sorted while they slide; a task holds one tile."""
    names, levels = list(quantiles), list(quantiles.values())
    kept = [f for f in tiled.schema if f.name not in (*names, count)]
    own = [f.name for f in kept]
    added = [*[T.StructField(c, T.DoubleType()) for c in names], T.StructField(count, T.LongType())]
    schema = T.StructType([*kept, *added])

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by(no)
        known, found = slide(table.column("_value").to_pylist(), n, levels)
        lost = pc.is_null(table.column(no)).combine_chunks()
        columns = [pc.if_else(lost, None, pa.array(c, pa.float64())) for c in found]
        columns.append(pc.if_else(lost, None, pa.array(known, pa.int64())))
        return pa.Table.from_arrays([*[table.column(c) for c in own], *columns], schema.names)

    made = tiled.select(*own, F.col(value).cast("double").alias("_value"))
    return made.groupBy(*groups).applyInArrow(run, schema)
