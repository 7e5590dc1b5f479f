"""Fixed table schemas and the check that a table carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

EVENTS = _schema(
    ("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S)
)
TICKS = _schema(("tick_id", L), ("symbol", S), ("ts", TS), ("price", D), ("spread", D))
BARS = _schema(
    ("symbol", S), ("tf", S), ("bar_ts", TS), ("open", D), ("high", D), ("low", D),
    ("close", D), ("volume", L), ("spread", D),
)
SYMBOLS = _schema(("symbol", S), ("contract_size", D), ("lot_step", D), ("tick_size", D))
ACCOUNTS = _schema(("account_id", L), ("balance", D))
FORECASTS = _schema(
    ("symbol", S), ("tf", S), ("bar_ts", TS), ("q10", D), ("q50", D), ("q90", D),
    ("p_bull", D), ("confidence", D),
)
PROPOSALS = _schema(
    ("order_id", L), ("symbol", S), ("ts", TS), ("side", S), ("entry", D), ("sl", D),
    ("tp", D), ("expiry_bars", I), ("p_win", D), ("friction", D),
)
ORDER_EVENTS = _schema(("event_id", L), ("order_id", L), ("ts", TS), ("kind", S))
POSITIONS = _schema(
    ("ticket", L), ("account_id", L), ("symbol", S), ("side", S), ("volume", D), ("entry", D)
)
TRADES = _schema(
    ("trade_id", L), ("account_id", L), ("strategy_id", L), ("symbol", S),
    ("open_ts", TS), ("close_ts", TS), ("pnl", D),
)
AUDIT = _schema(
    ("ts", TS), ("account_id", L), ("order_id", L), ("gate", S), ("decision", S), ("reason", S)
)


def with_long(schema: T.StructType, name: str) -> T.StructType:
    """Copy of a schema with one more BIGINT column."""
    return T.StructType([*schema.fields, T.StructField(name, L)])


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to `schema`; raise if a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("table lacks or mistypes " + ", ".join(wrong))
    return df.select(*schema.names)
