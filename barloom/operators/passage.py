"""First passage: the first bar ahead that reaches a level, without looking at every bar.

A question is a range of positions in a series and two levels. Within a tile of bars, block maxima and
minima of doubling width answer all its questions at once, in log2(range) steps for each. A range that
leaves its tile goes on over one row per tile, found the same way, and then down into the one tile that
holds the answer. So the cost does not grow with the range, and no bar is copied but into the tile before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import tiles
from barloom.operators.tiles import NO, SERIES
from barloom.session import store

#: Bars of the next tile that a tile sees; ranges that stay within need no second look.
HALO = 2048
#: Questions that one task answers; more on one tile are dealt to several.
CROWD = 200_000

BAR = ("bar_ts", "high", "low", "close")


def bar_struct() -> Column:
    return F.struct(NO, *BAR)


def question(first: Column, last: Column, up: Column, down: Column) -> Column:
    """Positions first..last; levels that are NULL are never reached."""
    return F.struct(
        first.cast("long").alias("first"), last.cast("long").alias("last"),
        up.cast("double").alias("up"), down.cast("double").alias("down"),
    )


def _no_bar(spark_type: T.DataType) -> Column:
    return F.lit(None).cast(spark_type)


def answered(line: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows with a question `_q`, with `_hit` and `_last`, from rows of bars, questions, or both.

    `_bar` is a struct of the position, high, low and what else the caller wants of a bar; each group
    (a tile with what it sees) is answered alone. `_hit` is the first bar of the range with high >= up or
    low <= down; without one, `_last` is the bar at the end of the range. NULL where the group has none.
    """
    bar = line.schema["_bar"].dataType
    names = [c for c in line.columns if c != "_bar"]
    schema = T.StructType([*[line.schema[c] for c in names], T.StructField("_hit", bar), T.StructField("_last", bar)])

    def levels(values, fold):
        out = [values]
        while len(out[-1]) > 1 << (len(out) - 1):
            step = 1 << (len(out) - 1)
            out.append(fold(out[-1][:-step], out[-1][step:]))
        return out

    def search(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bars = table.column("_bar").combine_chunks()
        bars = bars.filter(bars.is_valid())
        bars = bars.take(pc.sort_indices(pc.struct_field(bars, [0])))
        asked = table.filter(pc.is_valid(table.column("_q"))).select(names)
        if not len(asked):
            return schema_table(asked, bars, [], [])
        q = asked.column("_q").combine_chunks()
        first, last = (np.asarray(pc.struct_field(q, c).fill_null(-1)) for c in ("first", "last"))
        up, down = (np.asarray(pc.struct_field(q, c).cast(pa.float64()).fill_null(float("nan"))) for c in ("up", "down"))
        no = np.asarray(pc.struct_field(bars, NO), np.int64)
        high, low = (np.asarray(pc.struct_field(bars, c).cast(pa.float64()).fill_null(float("nan"))) for c in ("high", "low"))
        # Unknown prices reach nothing; a NaN is above every level.
        gone = [np.asarray(pc.struct_field(bars, c).is_null()) for c in ("high", "low")]
        high = np.where(gone[0], -np.inf, np.where(np.isnan(high), np.inf, high))
        low = np.where(gone[1] | np.isnan(low), np.inf, low)

        at, end = np.searchsorted(no, first, "left"), np.searchsorted(no, last, "right")
        most = int((end - at).max(initial=0))
        if most > 0:
            tops, bottoms = levels(high, np.maximum), levels(low, np.minimum)
            with np.errstate(invalid="ignore"):
                for k in range(most.bit_length() - 1, -1, -1):
                    block = np.minimum(at, len(tops[k]) - 1)
                    free = (at + (1 << k) <= end) & ~((tops[k][block] >= up) | (bottoms[k][block] <= down))
                    at = np.where(free, at + (1 << k), at)
        hit = (at < end) & (first >= 0)
        tail = np.maximum(end - 1, 0)
        there = ~hit & (end > 0) & (last >= first) & (first >= 0)
        if len(no):
            there &= no[tail] == last
        else:
            there[:] = False
        return schema_table(asked, bars, pa.array(at, pa.int64(), mask=~hit), pa.array(tail, pa.int64(), mask=~there))

    def schema_table(asked, bars, hit, last):
        import pyarrow as pa

        taken = [bars.take(i if isinstance(i, pa.Array) else pa.array(i, pa.int64())) for i in (hit, last)]
        return pa.Table.from_arrays([*asked.columns, *taken], [*names, "_hit", "_last"])

    return line.groupBy(*groups).applyInArrow(search, schema)


def first_passage(questions: DataFrame, bars: DataFrame, reach: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add `_hit` and `_last` (see `answered`) to the questions (keys, `_q`, further columns).

    `bars` has the keys, positions `bar_no` and `_bar`; `reach` is the longest range asked for. A row without
    key, range or levels has no answer. Questions that crowd on one tile are dealt to several tasks, each
    with the bars of the tile.
    """
    own = [*questions.columns]
    known = F.col("_q.first").isNotNull() & F.col("_q.last").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    asked = questions.filter(known).withColumn("_tile", F.floor(F.col("_q.first") / tiles.TILE))
    found = _on_tiles(asked, bars, keys, min(reach, HALO))
    if reach > HALO:
        found = store(found, "passage")
        found = further(found, bars, reach, keys, own)
    bar = bars.schema["_bar"].dataType
    rest = questions.filter(~F.coalesce(known, F.lit(False))).withColumns({c: _no_bar(bar) for c in ("_hit", "_last")})
    return found.select(*own, "_hit", "_last").unionByName(rest)


def _on_tiles(asked: DataFrame, bars: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """Questions with a `_tile` answered from the bars of that tile and `halo` more."""
    spread = tiles.tile(bars.filter(F.col(NO).isNotNull()).select(*keys, NO, "_bar"), after=halo, size=tiles.TILE)
    groups = [*keys, "_tile", "_part"]
    crowded = asked.groupBy(*keys, "_tile").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_parts"))
    crowded = store(crowded.filter("_parts > 1"), "passage-crowds")
    if crowded.isEmpty():
        asked, spread = (d.withColumn("_part", F.lit(0)) for d in (asked, spread))
    else:
        parts = F.coalesce("_parts", F.lit(1))
        spread = spread.join(crowded, [*keys, "_tile"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = F.pmod(F.xxhash64(F.struct(*asked.columns)), parts).cast("int")
        asked = asked.join(crowded, [*keys, "_tile"], "left").withColumn("_part", dealt).drop("_parts")
    rows = F.struct(*[c for c in asked.columns if c not in groups])
    payload = asked.select(rows.alias("r")).schema["r"].dataType
    spread = spread.select(*groups, "_bar", F.lit(None).cast(asked.schema["_q"].dataType).alias("_q"), F.lit(None).cast(payload).alias("_row"))
    line = spread.unionByName(
        asked.select(*groups, _no_bar(bars.schema["_bar"].dataType).alias("_bar"), "_q", rows.alias("_row"))
    )
    return answered(line, groups).select(*keys, "_tile", "_row.*", "_hit", "_last")


def further(found: DataFrame, bars: DataFrame, reach: int, keys: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Go on where the range leaves what its tile sees: over one row per tile, then into the tile of the answer."""
    tile_of = lambda c: F.floor(F.col(c) / tiles.TILE)
    ends = (F.col("_tile") + 1) * tiles.TILE + min(reach, HALO)
    is_open = F.coalesce(F.col("_hit").isNull() & (F.col("_q.last") >= ends), F.lit(False))
    left = found.filter(is_open).select(*own, "_tile")
    # The bars of the tile of the range's end may lie past it: that tile is always looked into last.
    up, down = F.col("_q.up"), F.col("_q.down")
    steps = left.withColumn("_row", F.struct(*own)).select(
        *keys, "_row", question(F.col("_tile") + 1, tile_of("_q.last") - 1, up, down).alias("_q")
    )
    coarse = bars.filter(F.col(NO).isNotNull()).groupBy(*keys, tile_of(NO).alias(NO)).agg(
        F.max("_bar.high").alias("high"), F.min("_bar.low").alias("low")
    )
    coarse = store(coarse.select(*keys, NO, F.struct(NO, "high", "low").alias("_bar")), "passage-tiles")
    there = first_passage(steps, coarse, reach // tiles.TILE + 1, keys)
    there = there.select(F.col("_hit").getField(NO).alias("_there"), "_row.*")
    there = there.withColumn("_tile", F.coalesce("_there", tile_of("_q.last"))).drop("_there")
    there = store(there.withColumn("_asked", F.col("_q.first")), "passage-further")
    begin = F.greatest(F.col("_tile") * tiles.TILE, "_q.first")
    asked = there.withColumn("_q", question(begin, F.col("_q.last"), up, down))
    wanted = store(asked.select(*keys, F.col("_tile").alias("_at")).distinct(), "passage-wanted")
    near = bars.withColumn("_at", tile_of(NO)).join(wanted, [*keys, "_at"], "left_semi").drop("_at")
    more = _on_tiles(asked, near, keys, 0)
    more = more.withColumn("_q", question(F.col("_asked"), F.col("_q.last"), up, down))
    return found.filter(~is_open).select(*own, "_hit", "_last").unionByName(more.select(*own, "_hit", "_last"))
