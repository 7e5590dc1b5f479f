"""Sizing, exposure, order states, risk gates, liquidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.clock import slot
from barloom.functions.sqlmath import ratio
from barloom.operators.tiles import Scan, running
from barloom.schemas import SYMBOLS, require
from barloom.session import store

_ENDS = "array<struct<event_id:bigint,placed:timestamp_ntz,state:string,ended:timestamp_ntz>>"
VERDICTS = {"A": "ACCEPT", "M": "MAX_OPEN", "D": "DAILY_LOSS"}
# Fixed value: closing time of a trade that has none.
NEVER = "9999-12-31 00:00:00"
# Ending events and the state they lead to.
TERMINAL = {"FILL": "FILLED", "CANCEL": "CANCELLED", "REJECT": "REJECTED"}


def size_lots(df: DataFrame, risk: float, kelly_cap: float, symbols: DataFrame) -> DataFrame:
    """Add `kelly` and `lots`: capped Kelly share, at most `risk` of the equity at the stop.

    `symbols` is the catalogue (`schemas.SYMBOLS`): contract size and lot step of each symbol.
    Lots are whole steps; a quotient within 1e-9 of a whole number of steps counts as it. An
    order whose symbol is not in the catalogue has NULL lots. The catalogue, one row per
    symbol, is stored first, so that its size is known and orders need no shuffle by symbol.
    """
    catalogue = require(symbols, SYMBOLS).select("symbol", "contract_size", "lot_step")
    known = store(catalogue, "symbols").withColumnRenamed("symbol", "_symbol")
    odds = ratio(F.abs(F.col("tp") - F.col("entry")), F.abs(F.col("entry") - F.col("sl")))
    full = F.col("p_win") - ratio(1 - F.col("p_win"), odds)
    # An order without a stop distance has no odds, and gets nothing.
    capped = F.greatest(F.least(full, F.lit(kelly_cap)), F.lit(0.0))
    kelly = F.when(full.isNotNull(), capped).otherwise(0.0)
    sized = df.withColumn("kelly", kelly).join(known, F.col("symbol") == F.col("_symbol"), "left")
    stop = F.abs(F.col("entry") - F.col("sl")) * F.col("contract_size")
    steps = F.floor(F.round(ratio(F.col("equity") * F.least("kelly", F.lit(risk)), stop * F.col("lot_step")), 9))
    # Whole steps times a decimal step: no binary fraction creeps in.
    lots = (steps.cast("decimal(18,0)") * F.col("lot_step").cast("decimal(12,6)")).cast("double")
    return sized.select(*df.columns, "kelly", lots.alias("lots"))


def open_count(trades: DataFrame, by: Sequence[str], grain: int = 60) -> DataFrame:
    """Trades open just after each opening, the opened one included.

    Openings add one and closings take one away on a common time line; at equal
    times closings come first, so a trade that closes at once is never open.
    """
    opened = trades.select(
        *by, F.col("open_ts").alias("_at"), F.lit(1).alias("_step"), "trade_id", "open_ts"
    )
    closed = trades.select(
        *by, F.col("close_ts").alias("_at"), F.lit(-1).alias("_step"), "trade_id", "open_ts"
    )
    scan = Scan("open_trades", "sum", F.col("_step").cast("bigint"))
    line = opened.unionByName(closed)
    counted = running(line, by, ["_at", "_step", "trade_id"], slot("_at", grain), [scan])
    return counted.filter(F.col("_step") == 1).select(*by, "trade_id", "open_ts", "open_trades")


def order_states(
    events: DataFrame,
    expiry: str,
    as_of: Column,
    grain: int = 60,
    opening: str = "PLACE",
    endings: Mapping[str, str] = TERMINAL,
) -> DataFrame:
    """Life of every placed order: when it was placed, how and when it ended by `as_of`.

    A PLACE opens an order unless one is open; FILL, CANCEL and REJECT end it, and so
    does the deadline. Nothing is open after an ending event, so the log of an id is
    cut there and each short stretch is folded alone: an id with very many events is
    not one task.
    """
    limit = F.expr(f"interval {expiry}")
    # An event without order or time belongs to no life.
    placed = F.col("order_id").isNotNull() & F.col("ts").isNotNull()
    log = events.filter(F.col("kind").isin(opening, *endings) & placed).select(
        "order_id", "event_id", "ts", "kind"
    )
    ending = F.when(F.col("kind") != opening, F.struct("ts", "event_id"))
    cut = running(
        log, ["order_id"], ["ts", "event_id"], slot("ts", grain), [Scan("_cut", "max", ending)],
        inclusive=False,
    )
    steps = cut.groupBy("order_id", "_cut").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))).alias("_steps")
    ).withColumn("_as_of", as_of)
    none = F.expr(f"cast(array() as {_ENDS})")
    start = F.struct(
        F.lit(None).cast("timestamp_ntz").alias("placed"),
        F.lit(None).cast("bigint").alias("event_id"),
        none.alias("ends"),
    )

    def end(acc: Column, state: Column, at: Column) -> Column:
        done = F.struct(
            acc.event_id.alias("event_id"), acc.placed.alias("placed"),
            state.alias("state"), at.alias("ended"),
        )
        return F.concat(acc.ends, F.array(done))

    def step(acc: Column, x: Column) -> Column:
        is_open = acc.placed.isNotNull()
        late = is_open & (x.ts > acc.placed + limit)
        places = x.kind == opening
        opens = places & (~is_open | late)
        closes = ~places & is_open & ~late
        state = F.lit(None).cast("string")
        for kind, name in endings.items():
            state = F.when(x.kind == kind, F.lit(name)).otherwise(state)
        ends = (
            F.when(late, end(acc, F.lit("EXPIRED"), acc.placed + limit))
            .when(closes, end(acc, state, x.ts))
            .otherwise(acc.ends)
        )
        keep = is_open & ~late & ~closes
        return F.struct(
            F.when(opens, x.ts).when(keep, acc.placed).alias("placed"),
            F.when(opens, x.event_id).when(keep, acc.event_id).alias("event_id"),
            ends.alias("ends"),
        )

    def finish(acc: Column) -> Column:
        late = acc.placed + limit < F.col("_as_of")
        state = F.when(late, F.lit("EXPIRED")).otherwise(F.lit("PENDING"))
        at = F.when(late, acc.placed + limit)
        return F.when(acc.placed.isNotNull(), end(acc, state, at)).otherwise(acc.ends)

    folded = steps.select("order_id", F.aggregate("_steps", start, step, finish).alias("_ends"))
    return folded.select("order_id", F.inline("_ends"))


def fold_days(days: DataFrame, max_open: int, daily_loss: float) -> DataFrame:
    """Add `_codes`, a letter per row of `_rows`, to the days of each (account_id, `_part`), in order.

    The days of a part are sorted in one task and folded one after the other; only the open trades are
    carried from day to day, so memory holds a day however long the part is.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = days.select(
        "account_id", "_part", "_day", "_rows",
        micros(F.col("_day")).alias("_start"),
        F.transform("_rows", lambda r: micros(r["_minute"])).alias("_minutes"),
        F.transform("_rows", lambda r: micros(r["_until"])).alias("_untils"),
        F.transform("_rows", lambda r: r["pnl"]).alias("_pnls"),
    )
    keys = ["account_id", "_part"]
    line = rows.repartition(*keys).sortWithinPartitions(*keys, "_day").drop("_day")
    schema = T.StructType([line.schema["account_id"], line.schema["_rows"], T.StructField("_codes", T.StringType())])

    def fold(batches):
        import pyarrow as pa

        part, held = None, []
        for batch in batches:
            codes = []
            own = zip(*[batch.column(c).to_pylist() for c in (*keys, "_start", "_minutes", "_untils", "_pnls")], strict=True)
            for account, number, start, minutes, untils, pnls in own:
                if (account, number) != part:
                    part, held = (account, number), []
                booked, letters, end = 0.0, [], start + 86_400_000_000
                for minute, until, pnl in zip(minutes, untils, pnls, strict=True):
                    if any(close < minute for close, _ in held):
                        for close, p in held:
                            booked += p if start <= close < minute and close < end else 0.0
                        held = [h for h in held if h[0] >= minute]
                    if booked <= -daily_loss:
                        letters.append("D")
                    elif len(held) >= max_open:
                        letters.append("M")
                    else:
                        letters.append("A")
                        held.append((until, pnl or 0.0))
                codes.append("".join(letters))
            yield pa.RecordBatch.from_arrays(
                [batch.column("account_id"), batch.column("_rows"), pa.array(codes, pa.string())], schema.names
            )

    return line.mapInArrow(fold, schema)


def risk_gate(
    proposals: DataFrame,
    max_spread: float,
    max_open: int,
    daily_loss: float,
) -> DataFrame:
    """Accept or reject trade proposals in time order, per account.

    Accepted trades occupy a place until the first minute that starts after they close, also
    over midnight; one without a closing time stays open. Their P/L is then booked, if it is
    still the UTC day in which they closed; the sum of booked results starts anew each day. A
    proposal is rejected unless its spread is known to be within `max_spread`, or when the P/L
    booked by the start of its minute is down to `-daily_loss`, or when `max_open` trades are
    open. One without account or time is rejected with the reason KEY.

    Since places are only freed between minutes, no more than the first `max_open` sound
    proposals of a minute can be accepted. Only these are folded, at most 1440 * max_open per
    account and day however many proposals there are; the rest follow from the state of their
    minute. An account's days are folded apart wherever no candidate is open at midnight, and one after
    the other where one is (`fold_days`): no array is longer than a day, even where trades never close.
    """
    known = F.col("account_id").isNotNull() & F.col("open_ts").isNotNull()
    sound = F.coalesce(F.col("spread") <= max_spread, F.lit(False)) & known
    w = Window.partitionBy("account_id", "_minute").orderBy(F.desc("_sound"), "open_ts", "trade_id")
    rows = proposals.withColumns(
        {"_day": F.to_date("open_ts"), "_minute": F.date_trunc("minute", "open_ts").cast("timestamp_ntz"), "_sound": sound}
    ).withColumn("_rn", F.row_number().over(w))
    first = rows.filter((F.col("_rn") <= max_open) & F.col("_sound"))
    until = F.coalesce("close_ts", F.lit(NEVER).cast("timestamp_ntz"))
    days = first.withColumn("_until", until).groupBy("account_id", "_day").agg(
        F.array_sort(
            F.collect_list(F.struct("open_ts", "trade_id", "_minute", "_rn", "_until", "pnl"))
        ).alias("_rows"),
        F.max("_until").alias("_until"),
    )
    earlier = Window.partitionBy("account_id").orderBy("_day")
    over = F.max("_until").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(over < F.col("_day").cast("timestamp_ntz"), F.lit(True)).cast("int")
    cut = days.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(earlier))
    days = fold_days(cut, max_open, daily_loss)

    # One letter per row: a string grows far cheaper than an array does.
    names = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    named = F.transform(
        "_rows",
        lambda r, i: F.struct(
            r["_minute"].alias("_minute"), r["_rn"].alias("_rn"),
            F.element_at(names, F.substr("_codes", i + 1, F.lit(1))).alias("v"),
        ),
    )
    judged = days.select("account_id", F.inline(named))
    # One row per minute, so the proposals stay where the ranking has put them.
    minutes = judged.groupBy("account_id", "_minute").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "v"))).alias("_verdicts"),
        F.bool_or(F.col("v") == "DAILY_LOSS").alias("_blocked"),
    )
    decided = rows.join(minutes, ["account_id", "_minute"], "left")
    own = F.get("_verdicts", F.col("_rn") - 1).getField("v")
    reason = (
        F.when(~known, "KEY")
        .when(~F.col("_sound"), "SPREAD")
        .when(own.isNotNull(), own)
        .when(F.col("_blocked"), "DAILY_LOSS")
        .otherwise("MAX_OPEN")
    )
    return decided.select(
        *proposals.columns,
        reason.alias("reason"),
        F.when(reason == "ACCEPT", "ACCEPT").otherwise("REJECT").alias("decision"),
    )


def audit_rows(decided: DataFrame) -> DataFrame:
    """Risk decisions in the layout of the audit log."""
    return decided.select(
        F.col("open_ts").alias("ts"),
        "account_id",
        F.col("trade_id").alias("order_id"),
        F.lit("risk").alias("gate"),
        "decision",
        "reason",
    )


def liquidation_set(valued: DataFrame, pending: DataFrame) -> DataFrame:
    """Closing rows for all valued positions and cancelling rows for all pending orders."""
    closing = valued.select(
        F.lit("CLOSE").alias("action"),
        F.col("ticket").alias("id"),
        F.when(F.col("side") == "BUY", "SELL").otherwise("BUY").alias("side"),
        "volume",
        F.col("quote").alias("price"),
        "floating_pnl",
    )
    cancelling = pending.select(
        F.lit("CANCEL").alias("action"),
        F.col("event_id").alias("id"),
        F.lit(None).cast("string").alias("side"),
        F.lit(None).cast("double").alias("volume"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("floating_pnl"),
    )
    return closing.unionByName(cancelling)
