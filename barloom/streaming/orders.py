"""Keyed state over streams of order events and of trade proposals."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.risk import TERMINAL
from barloom.streaming.ticks import clock_columns, event_time

LIFE = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("placed", T.TimestampType()),
        T.StructField("state", T.StringType()),
        T.StructField("ended", T.TimestampType()),
    ]
)
ALARM = T.StructType([T.StructField("at_ms", T.LongType())])
SLOT = T.StructType([T.StructField("slot", T.LongType())])
PACKED = T.StructType([T.StructField("rows", T.BinaryType())])
# Rows of a key that are gathered before they go into its state.
GATHERED = 1 << 18
# Keys that order ids are dealt to: a call of the state costs far more than a row.
PARTS = 256
DAY_US, HOUR_US, MINUTE_US, NEVER_US = 86_400_000_000, 3_600_000_000, 60_000_000, 1 << 62


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _stamp(us: pd.Series) -> pd.Series:
    return pd.to_datetime(us, unit="us")


def _packed(kinds: np.dtype, *columns) -> np.ndarray:
    rows = np.empty(len(columns[0]), kinds)
    for name, column in zip(kinds.names, columns, strict=True):
        rows[name] = column
    return rows


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort([rows[name] for name in reversed(rows.dtype.names)])]


class InOrder(StatefulProcessor):
    """Rows of a key in event-time order, however they are dealt to batches.

    Rows wait in state, packed by slots of time, until the watermark has passed them; a timer for the
    earliest one then hands over all that are due, sorted, a slot at a time. So a key's state holds the
    rows of a batch and of the lateness allowed, but memory only those of a slot. Rows behind the
    watermark, where Spark lets them through, go to `late`.
    """

    kinds: np.dtype  # of a row, time in microseconds (`us`) first, in sorting order
    slot_us: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", SLOT, PACKED)
        self.alarm = handle.getValueState("alarm", ALARM)

    def rows_of(self, batch: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def handle_due(self, key: Any, due: np.ndarray, clock_us: int) -> pd.DataFrame | None:
        """Work on the rows that are due, in order; none before the clock follow."""
        raise NotImplementedError

    def handle_late(self, key: Any, late: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def next_us(self) -> int | None:
        """When the key wants to be looked at without new rows."""
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, gathered, many, first = timerValues.getCurrentWatermarkInMs() * 1000, [], 0, None
        for frame in rows:
            found = self.rows_of(frame)
            late, found = found[found["us"] < clock], found[found["us"] >= clock]
            if len(late):
                yield self.handle_late(key, _sorted(late))
            if len(found):
                least = int(found["us"].min())
                first, many = least if first is None else min(first, least), many + len(found)
                gathered.append(found)
            if many >= GATHERED:
                self.keep(gathered)
                gathered, many = [], 0
        if gathered:
            self.keep(gathered)
        if first is not None:
            self.wake(first)

    def keep(self, gathered: list[np.ndarray]) -> None:
        rows = np.concatenate(gathered)
        slots = rows["us"] // self.slot_us
        order = np.argsort(slots, kind="stable")
        rows, slots = rows[order], slots[order]
        edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(rows)]
        for at, until in zip(edges, edges[1:]):
            slot = (int(slots[at]),)
            held = self.waiting.getValue(slot)
            self.waiting.updateValue(slot, ((bytes(held[0]) if held else b"") + rows[at:until].tobytes(),))

    def wake(self, us: int) -> None:
        at = us // 1000 + 1
        if self.alarm.exists():
            was = self.alarm.get()[0]
            if was <= at:
                return
            self.handle.deleteTimer(was)
        self.alarm.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        self.alarm.clear()
        for slot in sorted(k[0] for k in list(self.waiting.keys())):
            held = np.frombuffer(self.waiting.getValue((slot,))[0], self.kinds)
            due, rest = held[held["us"] < clock], held[held["us"] >= clock]
            if len(due):
                if len(rest):
                    self.waiting.updateValue((slot,), (rest.tobytes(),))
                else:
                    self.waiting.removeKey((slot,))
                out = self.handle_due(key, _sorted(due), min(clock, (slot + 1) * self.slot_us))
                if out is not None:
                    yield out
            if len(rest):
                first = int(rest["us"].min())
                break
        out = self.handle_due(key, np.empty(0, self.kinds), clock)
        if out is not None:
            yield out
        times = [t for t in (first, self.next_us()) if t is not None]
        if times:
            self.wake(min(times))

    def close(self) -> None:
        pass


class OrderLife(InOrder):
    """One open order per id, many ids a key; emits a row when it ends. Late events are emitted as LATE."""

    kinds = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("kind", "u1"), ("order_id", "<i8")])
    placed = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("order_id", "<i8")])
    slot_us = DAY_US

    def __init__(self, limit_us: int, opening: str, endings: Mapping[str, str]):
        self.limit_us, self.opening, self.endings = limit_us, opening, dict(endings)
        self.names = sorted({opening, *endings})

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", PACKED)

    def held(self) -> np.ndarray:
        return np.frombuffer(self.open.get()[0] if self.open.exists() else b"", self.placed)

    def rows_of(self, batch: pd.DataFrame) -> np.ndarray:
        codes = batch["kind"].map({name: i for i, name in enumerate(self.names)})
        return _packed(self.kinds, _micros(batch["ts"]), batch["event_id"].astype("int64"), codes, batch["order_id"])

    def next_us(self) -> int | None:
        held = self.held()
        return int(held["us"].min()) + self.limit_us if len(held) else None

    def handle_due(self, key: Any, due: np.ndarray, clock_us: int) -> pd.DataFrame | None:
        held = {order: (us, event_id) for us, event_id, order in self.held().tolist()}
        done, limit = [], self.limit_us
        for us, event_id, code, order in due.tolist():
            kind, at = self.names[code], held.get(order)
            if at is not None and at[0] + limit < us:
                done.append((order, at[1], at[0], "EXPIRED", at[0] + limit))
                del held[order]
                at = None
            if kind == self.opening:
                held.setdefault(order, (us, event_id))
            elif at is not None:
                done.append((order, at[1], at[0], self.endings[kind], us))
                del held[order]
        for order, (us, event_id) in list(held.items()):
            if us + limit < clock_us:
                done.append((order, event_id, us, "EXPIRED", us + limit))
                del held[order]
        if held:
            self.open.update((np.array([(*at, order) for order, at in held.items()], self.placed).tobytes(),))
        else:
            self.open.clear()
        return self._rows(done) if done else None

    def handle_late(self, key: Any, late: np.ndarray) -> pd.DataFrame:
        return self._rows([(order, i, us, "LATE", us) for us, i, _, order in late.tolist()])

    def _rows(self, done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(done, columns=["order_id", "event_id", "placed", "state", "ended"])
        return out.assign(placed=_stamp(out["placed"]), ended=_stamp(out["ended"]))


def order_fsm(
    events: DataFrame,
    limit_seconds: int,
    lateness: str,
    opening: str = "PLACE",
    endings: Mapping[str, str] = TERMINAL,
) -> DataFrame:
    """Ended orders of an event stream; the batch twin is `operators.risk.order_states`.

    Events are followed in event-time order once the watermark has passed them. Order ids are dealt
    to PARTS keys of the state, so its calls do not grow with the orders. With other kinds it also follows manual approvals: a proposal waits for APPROVE or
    DECLINE until its deadline.
    """
    placed = F.col("order_id").isNotNull() & F.col("ts").isNotNull()
    used = events.filter(F.col("kind").isin(opening, *endings) & placed)
    timed = event_time(used.select("order_id", "event_id", "ts", "kind"), lateness)
    dealt = timed.withColumn("part", F.pmod(F.xxhash64("order_id"), F.lit(PARTS)).cast("int"))
    lives = dealt.groupBy("part").transformWithStateInPandas(
        statefulProcessor=OrderLife(limit_seconds * 1_000_000, opening, endings),
        outputStructType=LIFE,
        outputMode="append",
        timeMode="EventTime",
    )
    return clock_columns(lives)


DECISION = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("open_ts", T.TimestampType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("day", T.LongType()),
        T.StructField("booked", T.DoubleType()),
        T.StructField("close_us", T.ArrayType(T.LongType())),
        T.StructField("pnl", T.ArrayType(T.DoubleType())),
    ]
)

class RiskLedger(InOrder):
    """Open trades and the booked results of the UTC day, per account; see `risk_gate`."""

    kinds = np.dtype([("us", "<i8"), ("trade_id", "<i8"), ("close_us", "<i8"), ("sound", "?"), ("pnl", "<f8")])
    slot_us = HOUR_US

    def __init__(self, max_open: int, daily_loss: float):
        self.max_open, self.daily_loss = max_open, daily_loss

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ledger = handle.getValueState("ledger", LEDGER)

    def rows_of(self, batch: pd.DataFrame) -> np.ndarray:
        opened, closed = _micros(batch["open_ts"]), _micros(batch["close_ts"])
        closed = closed.where(batch["close_ts"].notna(), NEVER_US)
        trades = batch["trade_id"].astype("int64")
        return _packed(self.kinds, opened, trades, closed, batch["sound"], batch["pnl"].fillna(0.0))

    def handle_due(self, key: Any, due: np.ndarray, clock_us: int) -> pd.DataFrame | None:
        if not len(due):
            return None
        day, booked, held = None, 0.0, []
        if self.ledger.exists():
            day, booked, closes, pnls = self.ledger.get()
            held = list(zip(closes, pnls))
        reasons = []
        for us, _, close_us, sound, pnl in due.tolist():
            if us // DAY_US != day:
                day, booked = us // DAY_US, 0.0
            minute = us - us % MINUTE_US
            booked += sum(p for at, p in held if at < minute and at // DAY_US == day)
            held = [(at, p) for at, p in held if at >= minute]
            if not sound:
                reasons.append("SPREAD")
            elif booked <= -self.daily_loss:
                reasons.append("DAILY_LOSS")
            elif len(held) >= self.max_open:
                reasons.append("MAX_OPEN")
            else:
                reasons.append("ACCEPT")
                held.append((close_us, pnl))
        self.ledger.update((int(day), float(booked), [h[0] for h in held], [h[1] for h in held]))
        return self._rows(key, due, reasons)

    def handle_late(self, key: Any, late: np.ndarray) -> pd.DataFrame:
        return self._rows(key, late, ["LATE"] * len(late))

    def _rows(self, key: Any, rows: np.ndarray, reasons: list[str]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "account_id": key[0], "trade_id": rows["trade_id"], "open_ts": _stamp(pd.Series(rows["us"])),
                "decision": ["ACCEPT" if r == "ACCEPT" else "REJECT" for r in reasons], "reason": reasons,
            }
        )


def risk_gate_stream(
    proposals: DataFrame, max_spread: float, max_open: int, daily_loss: float, lateness: str
) -> DataFrame:
    """Decisions on a stream of proposals; the batch twin is `operators.risk.risk_gate`.

    A proposal is decided when the watermark has passed it. The spread is judged before the
    state; proposals without account or time have no place in it and are left to the batch.
    """
    timed = event_time(proposals, lateness, "open_ts").withColumn(
        "close_ts", F.col("close_ts").cast("timestamp")
    )
    sound = F.coalesce(F.col("spread") <= max_spread, F.lit(False)).alias("sound")
    used = timed.select("account_id", "trade_id", "open_ts", "close_ts", sound, "pnl")
    used = used.filter(F.col("account_id").isNotNull() & F.col("open_ts").isNotNull())
    decided = used.groupBy("account_id").transformWithStateInPandas(
        statefulProcessor=RiskLedger(max_open, daily_loss),
        outputStructType=DECISION,
        outputMode="append",
        timeMode="EventTime",
    )
    return clock_columns(decided)
