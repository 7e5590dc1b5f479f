"""Streams of ticks: bars, de-duplication, fills, triggers, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom import schemas
from barloom.functions.clock import slot
from barloom.operators import features as ft
from barloom.operators.bars import to_bars
from barloom.operators.policy import trigger
from barloom.operators.tiles import SERIES


def event_time(stream: DataFrame, lateness: str, ts: str = "ts") -> DataFrame:
    """Watermark on the UTC clock column, which has to be TIMESTAMP in a stream."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def clock_columns(df: DataFrame) -> DataFrame:
    """Turn TIMESTAMP columns back into UTC clock columns."""
    clocks = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.withColumns(clocks) if clocks else df


def bars_stream(ticks: DataFrame, tf: str, lateness: str) -> DataFrame:
    """Bars of a tick stream: forming bars in update mode, closed bars in append mode."""
    return clock_columns(to_bars(event_time(ticks, lateness), tf))


def dedupe_stream(ticks: DataFrame, keys: Sequence[str], lateness: str) -> DataFrame:
    """First arrival of each key; state is kept for the lateness only."""
    return clock_columns(event_time(ticks, lateness).dropDuplicatesWithinWatermark(list(keys)))


def fills_stream(
    orders: DataFrame, bars: DataFrame, reach_seconds: int, lateness: str, as_clock: bool = True
) -> DataFrame:
    """Bars that reach the entry of a buy order between its placing and its expiry.

    `orders` (order_id, symbol, ts, entry) meet the bars that start after them, at
    most one per slot of the reach. Both are keyed by symbol and time bucket, an
    order being copied to the two buckets it can reach, so a hot symbol is spread.
    """
    reach = F.make_dt_interval(secs=F.lit(reach_seconds))
    placed = event_time(orders, lateness)
    ends = F.array(slot("ts", reach_seconds), slot("ts", reach_seconds) + 1)
    o = placed.withColumn("_bucket", F.explode(ends)).alias("o")
    closed = event_time(bars.select("symbol", "bar_ts", "low"), lateness, "bar_ts")
    b = closed.withColumn("_bucket", slot("bar_ts", reach_seconds)).alias("b")
    meets = (
        (F.col("o.symbol") == F.col("b.symbol"))
        & (F.col("o._bucket") == F.col("b._bucket"))
        & (F.col("b.bar_ts") > F.col("o.ts"))
        & (F.col("b.bar_ts") <= F.col("o.ts") + reach)
        & (F.col("b.low") <= F.col("o.entry"))
    )
    joined = o.join(b, meets).select(
        "o.order_id", "o.symbol", "o.ts", "o.entry", F.col("b.bar_ts").alias("fill_ts"), "b.low"
    )
    return clock_columns(joined) if as_clock else joined


def first_fills_stream(orders: DataFrame, bars: DataFrame, reach_seconds: int, lateness: str) -> DataFrame:
    """One row per filled buy order, with its earliest bar, once no earlier bar can arrive.

    The stream of touches goes on into an aggregation keyed by the order's own event time. Spark holds that
    operator's watermark back by the reach of the join before it, so late bars within the lateness still
    count. State holds one row per filled order of the reach and the lateness. Append mode.
    """
    touches = fills_stream(orders, bars, reach_seconds, lateness, as_clock=False)
    touches = touches.withColumn("fill_ts", F.col("fill_ts").cast("timestamp_ntz"))  # not an event time any more
    return clock_columns(first_fill(touches))


def first_fill(fills: DataFrame) -> DataFrame:
    """Earliest fill of each order."""
    return fills.groupBy("order_id", "symbol", "ts", "entry").agg(F.min("fill_ts").alias("fill_ts"))


def autopilot_stream(forecasts: DataFrame, threshold: float) -> DataFrame:
    """Forecasts of a stream that are confident enough to send an order."""
    return trigger(forecasts, threshold)


class FeatureAppender:
    """`foreachBatch` writer that adds features to each batch of new bars.

    Each batch leaves the last bars of every series that the features look back on as
    the tail for the next one, so a batch reads itself and one bounded tail, never the
    history. Batches write folders of their own: repeating one changes nothing.
    """

    def __init__(self, tail: str, out: str, features: Sequence[ft.Feature]):
        self.tail, self.out, self.features = tail, out, tuple(features)
        self.rows = max(f.before for f in features)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = batch.select(*schemas.BARS.names).withColumn("_new", F.lit(True))
        if batch_id > 0:
            before = spark.read.schema(schemas.BARS).parquet(f"{self.tail}/batch={batch_id - 1}")
            line = line.unionByName(before.withColumn("_new", F.lit(False)))
        line = line.persist()  # read for the tail, the row counts and the features
        newest = Window.partitionBy(*SERIES).orderBy(F.col("bar_ts").desc())
        kept = line.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= self.rows)
        kept.select(*schemas.BARS.names).write.mode("overwrite").parquet(
            f"{self.tail}/batch={batch_id}"
        )
        made = ft.compute(line, *self.features).filter("_new").drop("_new")
        made.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        line.unpersist()


def features_stream(
    bars: DataFrame, tail: str, out: str, checkpoint: str, features: Sequence[ft.Feature]
):
    """Start a stream that appends the features of new bars to `out`."""
    return (
        bars.writeStream.foreachBatch(FeatureAppender(tail, out, features))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
