"""Scale-free, causal bar features.

A `Feature` is a short list of stages; each stage adds columns over one window and
then recursive averages. `compute` merges the stages of any set of features on one
tiling: the whole set costs one shuffle, and what several features need (such as
the true range) is computed once.

Recursive averages are unrolled without Python: after a round with radix r,
s[t] + beta^k s[t-k] + ... + beta^((r-1)k) s[t-(r-1)k] covers r times as many rows,
so a look-back of 512 rows takes three rounds of lags.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.clock import SESSIONS, WIDTHS, in_session
from barloom.functions.sqlmath import ratio
from barloom.operators.tiles import NO, SERIES, TILE, TILE_OVER, core, number_bars, tile, tile_window

# Weight left outside the look-back of a recursive average; below double precision.
TAIL = 1e-15
RADIX = 8

Expr = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Average:
    """Recursive average of a column.

    A `price` is averaged through its changes, so that an unchanged price gives
    exactly itself; other inputs are at least zero or oscillate around it.
    """

    column: str
    alpha: float
    price: bool = False


@dataclass(frozen=True)
class Stage:
    """Columns first, then averages."""

    columns: Mapping[str, Expr] = field(default_factory=dict)
    averages: Mapping[str, Average] = field(default_factory=dict)


@dataclass(frozen=True)
class Feature:
    outputs: tuple[str, ...]
    before: int
    stages: tuple[Stage, ...]
    after: int = 0


def compute(bars: DataFrame, *features: Feature, size: int = TILE) -> DataFrame:
    """Add the columns of all features to the bars; `size` is the tile size in rows."""
    before, after = max(f.before for f in features), max(f.after for f in features)
    rowwise = before == after == 0
    df = bars if rowwise else tile(number_bars(bars), before, after, size)
    df = apply_stages(df, tile_window(), features)
    df = df if rowwise else core(df, size)
    names = [n for f in features for n in f.outputs]
    if not rowwise and NO in df.columns:  # rows without a position have no neighbours
        df = df.withColumns({n: F.when(F.col(NO).isNotNull(), F.col(n)) for n in names})
    return df.select(*[c for c in bars.columns if c not in names], *names)


def features_between(
    bars: DataFrame, start: datetime, end: datetime, *features: Feature, size: int = TILE
) -> DataFrame:
    """The features of the bars with start <= bar_ts < end, reading no more than they need.

    `bars` is a numbered store. Features look back a number of bars, so the read begins
    where every series has that many before its first bar of the range: the time is first
    guessed from the bar widths and doubled until it suffices or the store's beginning is
    reached. A `year` column, if there is one, prunes folders.
    """
    before, after = max(f.before for f in features), max(f.after for f in features)
    if after:
        raise ValueError("features of a range must not look ahead")

    def since(lo: datetime) -> DataFrame:
        rows = bars.filter((F.col("bar_ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("bar_ts") < until))
        if "year" in bars.columns:
            rows = rows.filter(F.col("year").between(lo.year, end.year))
        return rows

    from_, until = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = F.col("bar_ts") >= from_
    tfs = [r.tf for r in since(start).select("tf").distinct().collect()]  # a handful
    reach = timedelta(seconds=before * max([WIDTHS[t] for t in tfs], default=0)) + timedelta(days=4)
    while before:
        # Series that lack bars before the range and whose first bar is not read yet.
        spans = since(start - reach).groupBy(*SERIES).agg(
            F.min(NO).alias("lo"), F.min(F.when(inside, F.col(NO))).alias("first")
        )
        if spans.filter((F.col("lo") > 0) & (F.col("lo") > F.col("first") - before)).isEmpty():
            break
        if bars.filter(F.col("bar_ts") < F.lit(start - reach).cast("timestamp_ntz")).isEmpty():
            break
        reach *= 2
    return compute(since(start - reach), *features, size=size).filter(inside)


def apply_stages(df: DataFrame, w: WindowSpec, features: tuple[Feature, ...]) -> DataFrame:
    for i in range(max(len(f.stages) for f in features)):
        columns: dict[str, Expr] = {}
        averages: dict[str, Average] = {}
        for feature in features:
            if i < len(feature.stages):
                columns.update(feature.stages[i].columns)
                averages.update(feature.stages[i].averages)
        if columns:
            df = df.withColumns({name: expr(w) for name, expr in columns.items()})
        if averages:
            df = recursive_average(df, averages)
    return df


def radices(alpha: float) -> list[int]:
    """Radix of each round, so that the weight beyond their product is below TAIL."""
    need = math.log(TAIL) / math.log1p(-alpha)
    out, reach = [], 1
    while reach < need:
        out.append(min(RADIX, math.ceil(need / reach)))
        reach *= out[-1]
    return out


def average_rows(alpha: float) -> int:
    """Rows of look-back that a recursive average reads."""
    return math.prod(radices(alpha))


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def recursive_average(df: DataFrame, specs: Mapping[str, Average]) -> DataFrame:
    """Add e[t] = e[t-1] + alpha * (x[t] - e[t-1]) with e[0] = x[0] for each spec.

    The first row that is present seeds the average, so a store filtered by time gives the
    averages of what is left of it. (The first copied row of a tile does so as well, which
    weighs less than TAIL in the tile's own rows.)
    For a price the distance d = x - e is built: d[t] = beta * (d[t-1] + x[t] - x[t-1]).
    The rounds are many similar terms, so they are given to Spark as SQL text.
    """
    start, finish = {}, {}
    for out, spec in specs.items():
        x, beta = spec.column, 1 - spec.alpha
        if spec.price:
            start[out] = F.expr(f"{beta!r}D * ({x} - lag({x}, 1, {x}) {TILE_OVER})")
            finish[out] = F.expr(f"{x} - {out}")
        else:
            start[out] = F.expr(f"if(lag({NO}) {TILE_OVER} is null, {x}, {spec.alpha!r}D * {x})")
    df = df.withColumns(start)
    plans = {out: radices(spec.alpha) for out, spec in specs.items()}
    for i in range(max(map(len, plans.values()))):
        step = {}
        for out, spec in specs.items():
            if i >= len(plans[out]):
                continue
            stride = math.prod(plans[out][:i])
            lags = [j * stride for j in range(1, plans[out][i])]
            terms = [f"{(1 - spec.alpha) ** k!r}D * lag({out}, {k}, 0D) {TILE_OVER}" for k in lags]
            step[out] = F.expr(" + ".join([out, *terms]))
        df = df.withColumns(step)
    return df.withColumns(finish) if finish else df


def _range() -> Column:
    return F.col("high") - F.col("low")


def _part(x: Column) -> Column:
    return F.when(_range() == 0, 0.0).otherwise(ratio(x, _range()))


def body_ratio() -> Feature:
    body = Stage({"body_ratio": lambda w: _part(F.abs(F.col("close") - F.col("open")))})
    return Feature(("body_ratio",), 0, (body,))


def wick_ratios() -> Feature:
    wicks = Stage(
        {
            "upper_wick": lambda w: _part(F.col("high") - F.greatest("open", "close")),
            "lower_wick": lambda w: _part(F.least("open", "close") - F.col("low")),
        }
    )
    return Feature(("upper_wick", "lower_wick"), 0, (wicks,))


def _true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    # greatest() skips the NULL distances of the first bar.
    return F.greatest(_range(), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def true_range() -> Feature:
    return Feature(("tr",), 1, (Stage({"tr": _true_range}),))


def _atr_stage(*periods: int) -> Stage:
    return Stage({"_tr": _true_range}, {f"_atr{n}": Average("_tr", 1.0 / n) for n in periods})


def _atr_rows(n: int) -> int:
    return average_rows(1.0 / n) + 1


def atr(n: int = 14) -> Feature:
    out = Stage({"atr": lambda w: F.col(f"_atr{n}")})
    return Feature(("atr",), _atr_rows(n), (_atr_stage(n), out))


def range_to_atr(n: int = 14) -> Feature:
    out = Stage({"range_to_atr": lambda w: ratio(_range(), f"_atr{n}")})
    return Feature(("range_to_atr",), _atr_rows(n), (_atr_stage(n), out))


def natr(n: int = 14) -> Feature:
    out = Stage({"natr": lambda w: ratio(f"_atr{n}", "close")})
    return Feature(("natr",), _atr_rows(n), (_atr_stage(n), out))


def vol_expansion(fast: int = 5, slow: int = 50) -> Feature:
    out = Stage({"vol_expansion": lambda w: ratio(f"_atr{fast}", f"_atr{slow}")})
    return Feature(("vol_expansion",), _atr_rows(max(fast, slow)), (_atr_stage(fast, slow), out))


def ema(column: str = "close", n: int = 12) -> Feature:
    alpha = span_alpha(n)
    return Feature(("ema",), average_rows(alpha), (Stage(averages={"ema": Average(column, alpha, price=True)}),))


def ema_z(n: int = 20, win: int = 50) -> Feature:
    """Deviation from the average, as a z-score over `win` rows."""
    e, d = f"_ema{n}", f"_dev{n}"

    def z(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-win + 1, 0)
        return ratio(F.col(d) - F.avg(d).over(frame), F.stddev_samp(d).over(frame))

    stages = (
        Stage(averages={e: Average("close", span_alpha(n), price=True)}),
        Stage({d: lambda w: ratio("close", e) - 1}),
        Stage({"ema_z": z}),
    )
    return Feature(("ema_z",), average_rows(span_alpha(n)) + win, stages)


def rsi(n: int = 14) -> Feature:
    """RSI on [-1, 1]; 0 when there was no move."""

    def move(w: WindowSpec, sign: int) -> Column:
        change = sign * (F.col("close") - F.lag("close").over(w))
        return F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0))

    g, l = f"_gain{n}", f"_loss{n}"
    total = F.col(g) + F.col(l)
    stages = (
        Stage(
            {"_up": lambda w: move(w, 1), "_down": lambda w: move(w, -1)},
            {g: Average("_up", 1.0 / n), l: Average("_down", 1.0 / n)},
        ),
        Stage({"rsi": lambda w: F.when(total == 0, 0.0).otherwise((100 * ratio(g, total) - 50) / 50)}),
    )
    return Feature(("rsi",), _atr_rows(n), stages)


def macd_ratio(fast: int = 12, slow: int = 26, signal: int = 9) -> Feature:
    f, s = f"_ema{fast}", f"_ema{slow}"
    stages = (
        Stage(
            averages={
                f: Average("close", span_alpha(fast), price=True),
                s: Average("close", span_alpha(slow), price=True),
            }
        ),
        Stage(
            {"macd": lambda w: ratio(F.col(f) - F.col(s), "close")},
            {"macd_signal": Average("macd", span_alpha(signal))},
        ),
        Stage({"macd_hist": lambda w: F.col("macd") - F.col("macd_signal")}),
    )
    rows = average_rows(span_alpha(max(fast, slow))) + average_rows(span_alpha(signal))
    return Feature(("macd", "macd_signal", "macd_hist"), rows, stages)


def bb_width(n: int = 20, k: float = 2.0) -> Feature:
    def width(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-n + 1, 0)
        return ratio(2 * k * F.stddev_pop("close").over(frame), F.avg("close").over(frame))

    return Feature(("bb_width",), n, (Stage({"bb_width": width}),))


def session_masks() -> Feature:
    """Which trading sessions a bar starts in, by local clocks."""
    masks = {s: in_session("bar_ts", s) for s in SESSIONS}
    stage = Stage(
        {
            "asian": lambda w: masks["asian"],
            "london": lambda w: masks["london"],
            "ny_overlap": lambda w: masks["london"] & masks["new_york"],
            "london_close": lambda w: masks["london_close"],
        }
    )
    return Feature(("asian", "london", "ny_overlap", "london_close"), 0, (stage,))


def causal_scale(cols: tuple[str, ...], win: int = 50, min_n: int = 20) -> Feature:
    """Scale by mean and deviation of the `win` rows before the current one."""

    def scaled(c: str) -> Expr:
        def expr(w: WindowSpec) -> Column:
            frame = w.rowsBetween(-win, -1)
            z = ratio(F.col(c) - F.avg(c).over(frame), F.stddev_samp(c).over(frame))
            return F.when(F.count(c).over(frame) >= min_n, z)

        return expr

    outputs = tuple(f"{c}_scaled" for c in cols)
    return Feature(outputs, win, (Stage({o: scaled(c) for o, c in zip(outputs, cols)}),))


def full_set() -> tuple[Feature, ...]:
    """Every bar feature with its default parameters."""
    return (
        body_ratio(), wick_ratios(), true_range(), atr(), range_to_atr(), natr(),
        vol_expansion(), ema(), ema_z(), rsi(), macd_ratio(), bb_width(), session_masks(),
        causal_scale(("close", "volume")),
    )
