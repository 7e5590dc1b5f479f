"""Walk-forward folds, permutation and stress tests, Monte Carlo, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.clock import plus_seconds, slot
from barloom.operators import draws
from barloom.operators.metrics import chain, path_summary
from barloom.operators.tiles import asof, number, tiled
from barloom.session import store

Fold = tuple[int, datetime, datetime]


def equal_folds(start: datetime, end: datetime, k: int) -> list[Fold]:
    """k equal test periods; the first stretch of the same length only trains."""
    step = (end - start) / (k + 1)
    return [(i, start + step * i, start + step * (i + 1)) for i in range(1, k + 1)]


def purged_folds(
    df: DataFrame, folds: Sequence[Fold], embargo: timedelta, label_end: str = "label_end"
) -> DataFrame:
    """Rows with `fold` and `role`; a row may train several folds and test one.

    A row trains a fold if its label ends before the test period less the embargo.
    The folds are a literal list, so a row is copied without any join.
    """
    roles = []
    for k, start, end in folds:
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
        until = F.lit(start - embargo).cast("timestamp_ntz")
        role = F.when((F.col("bar_ts") >= lo) & (F.col("bar_ts") < hi), "test").when(
            F.col(label_end) < until, "train"
        )
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    return df.select("*", F.inline(F.array_compact(F.array(*roles))))


def walk_forward(
    df: DataFrame,
    folds: Sequence[Fold],
    embargo: timedelta,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    label_end: str = "label_end",
) -> DataFrame:
    """Out-of-sample scores of every fold: `fit(train)` returns the scorer of its test rows.

    The only loop is over the few folds; training and scoring are Spark jobs. The table
    is stored once, since every fold reads it.
    """
    df = store(df, "walk-forward")
    scored = []
    for k, start, end in folds:
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
        train = df.filter(F.col(label_end) < F.lit(start - embargo).cast("timestamp_ntz"))
        test = df.filter((F.col("bar_ts") >= lo) & (F.col("bar_ts") < hi))
        scored.append(fit(train)(test).withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, scored)


def permutation_test(scored: DataFrame, runs: int, seed: int) -> DataFrame:
    """Hit rate of each run after its outcomes are shuffled within the symbol; run 0 is as is.

    `scored` has symbol, bar_ts, predicted and outcome. A run's order of the rows is
    the order of their hashes; positions come from counts of hash ranges, so a hot
    symbol is ranked by many tasks, and predictions meet outcomes by position.
    """
    numbered = number(scored, ["symbol"], ["bar_ts"], slot("bar_ts", 86400), "pos")
    left = numbered.select("symbol", "pos", "predicted")
    drawn = scored.select(
        "symbol",
        "bar_ts",
        "outcome",
        F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"),
    ).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "run", "symbol", "bar_ts")))
    # 65,536 ranges of hashes for each symbol and run.
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint")
    ranked = number(drawn, ["symbol", "run"], ["_h"], bucket, "pos")
    pairs = ranked.join(left, ["symbol", "pos"]).select("run", "predicted", "outcome")
    actual = scored.select(F.lit(0).alias("run"), "predicted", "outcome")
    hit = (F.col("predicted") == F.col("outcome")).cast("double")
    return (
        pairs.unionByName(actual)
        .groupBy("run")
        .agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"))
    )


def friction_shock(
    trades: DataFrame,
    ticks: DataFrame,
    scenarios: Iterable[tuple[str, float, int]],
    grain: int = 60,
) -> DataFrame:
    """Trades priced again under each scenario (name, spread factor, slippage in ms).

    Entry and exit take the last tick at or before their time plus the slippage; the
    widened spread of the entry tick is paid once. Quotes are looked up once per trade, leg
    and distinct slippage, in one as-of pass; scenarios are laid over them afterwards.
    `status` is PRICED, or NO_QUOTE with a NULL P/L where a leg has no quote.
    """
    scenarios = [(n, float(m), int(ms)) for n, m, ms in scenarios]
    cases = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("_mult"), F.lit(ms).alias("_ms"))
            for n, m, ms in scenarios
        ]
    )
    looks = F.array(
        *[
            F.struct(F.lit(ms).alias("_ms"), F.lit(leg).alias("_leg"), F.col(at).alias("_at"))
            for ms in sorted({ms for _, _, ms in scenarios})
            for leg, at in (("in", "open_ts"), ("out", "close_ts"))
        ]
    )
    way = F.when(F.col("side") == "BUY", 1).otherwise(-1).alias("_way")
    legs = trades.select("strategy_id", "trade_id", "symbol", way, F.inline(looks))
    legs = legs.withColumn("_when", plus_seconds("_at", F.col("_ms") / 1000)).drop("_at")
    priced = asof(
        legs, ticks, ["symbol"], "_when", "ts", ["price", "spread"], grain, right_order=["tick_id"]
    )
    into = F.col("_leg") == "in"
    quoted = priced.groupBy("strategy_id", "trade_id", "_way", "_ms").agg(
        F.max(F.when(into, F.col("price"))).alias("_in"),
        F.max(F.when(into, F.col("spread"))).alias("_spread"),
        F.max(F.when(~into, F.col("price"))).alias("_out"),
    )
    of_slip = F.filter(cases, lambda c: c["_ms"] == F.col("_ms"))
    rows = quoted.withColumn("_c", F.explode(of_slip)).select("*", "_c.scenario", "_c._mult")
    pnl = F.col("_way") * (F.col("_out") - F.col("_in")) - F.col("_mult") * F.col("_spread")
    status = F.when(pnl.isNotNull(), "PRICED").otherwise("NO_QUOTE")
    return rows.select("strategy_id", "scenario", "trade_id", pnl.alias("pnl"), status.alias("status"))


def day_blocks(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Numbered trading days of each key with the summary of their P/L path."""
    minutes = path_summary(trades, by, ["close_ts", "trade_id"], slot("close_ts", 60))
    dated = minutes.withColumn("_day", F.floor(F.col("_chunk") / 1440))
    days = chain(dated, [*by, "_day"], "_chunk")
    return number(days, by, ["_day"], F.floor(F.col("_day") / 366), "block_no").drop("_day")


def trade_blocks(trades: DataFrame, by: Sequence[str], grain: int = 60) -> DataFrame:
    """Numbered trades of each key, each with the summary of its own P/L."""
    numbered = number(trades, by, ["close_ts", "trade_id"], slot("close_ts", grain), "block_no")
    pnl = F.col("pnl")
    return numbered.select(
        *by,
        "block_no",
        pnl.alias("total"),
        F.greatest(pnl, F.lit(0.0)).alias("top"),
        F.least(pnl, F.lit(0.0)).alias("fall"),
        F.greatest(-pnl, F.lit(0.0)).alias("drop"),
    )


def moving_blocks(trades: DataFrame, by: Sequence[str], length: int, grain: int = 60) -> DataFrame:
    """Every run of `length` consecutive trades of each key as one block, numbered by its first trade.

    A block's summary is put together from runs of doubling length, as in a segment tree: log2(length)
    steps over neighbours within a tile, whatever the length. A key of fewer trades has one block, all of them.
    """
    by, parts = list(by), ("total", "top", "fall", "drop")

    def joined(a: Sequence[str], b: Sequence[Column]) -> dict[str, Column]:
        """The summary of the columns a followed by b."""
        start = F.col(a[0])
        values = (
            start + b[0], F.greatest(a[1], start + b[1]), F.least(a[2], start + b[2]),
            F.greatest(a[3], b[3], F.col(a[1]) - (start + b[2])),
        )
        return dict(zip(a, values, strict=True))

    def ahead(names: Sequence[str], steps: int, w: WindowSpec) -> list[Column]:
        return [F.coalesce(F.lead(n, steps).over(w), F.lit(0.0)) for n in names]

    def spans(df: DataFrame, w: WindowSpec) -> DataFrame:
        run, done, size = [f"_run_{p}" for p in parts], 0, 1
        df = df.withColumn("_whole", F.lead("block_no", length - 1).over(w).isNotNull() if length > 1 else F.lit(True))
        df = df.withColumns({r: F.col(p) for r, p in zip(run, parts, strict=True)})
        df = df.withColumns({p: F.lit(0.0) for p in parts})
        while size <= length:
            if length & size:
                df = df.withColumns(joined(parts, ahead(run, done, w) if done else [F.col(r) for r in run]))
                done += size
            if 2 * size <= length:
                df = df.withColumns(joined(run, ahead(run, size, w)))
            size *= 2
        return df.filter(F.col("_whole") | (F.col("block_no") == 0)).drop("_whole", *run)

    return tiled(trade_blocks(trades, by, grain), spans, after=length, keys=by, no="block_no")


def mc_drawdown(
    blocks: DataFrame, by: Sequence[str], runs: int, seed: int, stretch: int = 1024, length: int = 1
) -> DataFrame:
    """Maximum drawdown of `runs` sequences, each drawn with replacement from the blocks.

    A run draws as many blocks as there are; of `moving_blocks` of some `length`, which overlap, as many
    as cover the trades, so that a run costs no more than its trades divided by the length.

    Every position of a run picks a block by hash. A task holds the draws of some stretches of
    a key, at most `draws.HELD`, and reads the stored blocks, which come by it in slices: neither
    draws nor copies of blocks are shuffled, and none pass through the driver. Summaries of the
    stretches are chained per run, so a long run is no single task.
    """
    by, stretch = list(by), min(stretch, draws.HELD)
    spark = blocks.sparkSession
    blocks = store(blocks.filter(F.col("block_no").isNotNull()), "mc-blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sizes = blocks.groupBy(*by).agg(F.count("*").alias("_n")).withColumn(
        "_draws", F.ceil((F.col("_n") + (length - 1)) / length)
    )
    count = F.ceil(F.col("_draws") / stretch) * runs
    # As many for a task to hold as give every task some, unless they are few or fewer than the blocks that come by.
    least = F.lit(max(1, draws.LEAST // stretch))
    share = F.least(
        F.lit(draws.HELD // stretch), F.greatest(F.ceil(count / (2 * tasks)), F.ceil(F.col("_n") / stretch), least)
    ).cast("bigint")
    turns = sizes.withColumns({"_count": count, "_share": share}).withColumn(
        "_turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_count") - 1) / F.col("_share"))))
    )
    lo = F.col("_turn") * F.col("_share")
    held = turns.select(
        *by, "_n", "_draws", "_turn", lo.alias("_lo"), F.least(lo + F.col("_share"), "_count").alias("_hi")
    )
    slices = store(draws.sliced(blocks, by), "mc-slices")
    stretches = draws.stretches_of(slices, store(held, "mc-held"), by, seed, stretch, tasks)
    return chain(stretches, [*by, "run"], "_part").select(
        *by, "run", F.col("total").alias("profit"), F.col("drop").alias("max_drawdown")
    )


def drawdown_report(simulated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distribution of the simulated drawdowns."""
    at = lambda q: F.percentile("max_drawdown", F.lit(q))
    return simulated.groupBy(*by).agg(
        F.count("*").alias("runs"),
        at(0.5).alias("dd_p50"),
        at(0.95).alias("dd_p95"),
        at(0.99).alias("dd_p99"),
        F.max("max_drawdown").alias("dd_worst"),
        F.avg((F.col("profit") < 0).cast("double")).alias("loss_share"),
    )


def gates(report: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `reasons`, the names of the rules that a strategy fails, and `passed`."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return report.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0)


def default_gates(
    min_factor: float = 1.2, min_win: float = 0.5, max_fall: float = 500.0, min_dsr: float = 0.95
) -> dict[str, Column]:
    return {
        "profit_factor": F.col("profit_factor") >= min_factor,
        "win_rate": F.col("win_rate") >= min_win,
        "max_drawdown": F.col("max_drawdown") <= max_fall,
        "dsr": F.col("dsr") >= min_dsr,
    }


