"""Run a stream over what has landed and read its result back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import dedupe
from barloom.schemas import with_long
from barloom.session import fresh_dir


def drain_append(df: DataFrame, label: str) -> DataFrame:
    """Write an append stream to Parquet, exactly once through its checkpoint."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def drain_updates(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an update stream; each batch overwrites its own folder, the newest row wins."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    rows = spark.read.schema(with_long(df.schema, "batch")).parquet(f"{path}/out")
    return dedupe(rows, keys, [F.col("batch").desc()]).drop("batch")
