"""Market tables as views over the `events` and `customer` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.clock import plus_seconds
from barloom.operators.bars import to_bars
from barloom.operators.tiles import NO, number_bars
from barloom.session import fresh_dir, store

# Fixed value: prices around this level give profits and losses of both signs.
PNL_LEVEL = 49.63

_stores: dict[tuple, str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def tick_view(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("tick_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.round(F.col("value") * _k() / 10000.0, 6).alias("spread"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_view(events(spark, sf_dir))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with the time at which they arrived, k minutes late."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("tick_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.round(F.col("value") * _k() / 10000.0, 6).alias("spread"),
        plus_seconds("ts", _k() * 60).alias("arrived_at"),
    )


def order_event_view(ev: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "PLACE")
        .when(F.col("event_type") == "purchase", "FILL")
        .when(F.col("event_type") == "click", "CANCEL")
        .when(F.col("event_type") == "error", "REJECT")
        .otherwise("QUOTE")
    )
    return ev.select("event_id", F.col("user_id").alias("order_id"), "ts", kind.alias("kind"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_event_view(events(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("trade_id"),
        (F.col("user_id") % 10).alias("account_id"),
        (F.col("user_id") % 4).alias("strategy_id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("open_ts"),
        plus_seconds("ts", _k() * 60).alias("close_ts"),
        F.round(F.col("value") - PNL_LEVEL, 2).alias("pnl"),
    )


def offers_view(ev: DataFrame) -> DataFrame:
    """Trades that are yet to pass the risk gates, with the spread at their opening."""
    return ev.select(
        F.col("event_id").alias("trade_id"),
        (F.col("user_id") % 10).alias("account_id"),
        F.col("ts").alias("open_ts"),
        plus_seconds("ts", _k() * 60).alias("close_ts"),
        F.round(F.col("value") * _k() / 10000.0, 6).alias("spread"),
        F.round(F.col("value") - PNL_LEVEL, 2).alias("pnl"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("balance")
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions: one per event, on the account of its user."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("ticket"),
        F.col("user_id").alias("account_id"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (_k() / 100.0).alias("volume"),
        F.col("value").alias("entry"),
    )


def bars(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    """Numbered bars, built from the ticks once per application and state of the files."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    )
    state = tuple(sorted(map(tuple, files.distinct().collect())))  # a row per file
    slot = (spark.sparkContext.applicationId, state, tf)
    schema = schemas.with_long(schemas.BARS, NO)
    if slot not in _stores:
        path = fresh_dir(spark, f"bars-{tf}")
        # Stored before numbering, which reads its input twice: ticks are scanned once.
        built = number_bars(store(to_bars(ticks(spark, sf_dir), tf), f"raw-{tf}"))
        built.write.mode("errorifexists").parquet(path)
        _stores[slot] = path
    return spark.read.schema(schema).parquet(_stores[slot])
