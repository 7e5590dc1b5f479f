"""File sources and sinks: landed ticks and bars, the immutable store, the audit log."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.clock import seconds

CORRUPT = "_corrupt_record"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read landed files with a fixed schema.

    Text formats keep unreadable lines in `_corrupt_record`, for `split_corrupt`.
    """
    reader = spark.read.options(**options)
    if fmt == "parquet":
        return schemas.require(reader.parquet(path), schema)  # a column that is missing is an error
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        reader.format(fmt)
        .schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .load(path)
    )


def read_ticks(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, path, schemas.TICKS, fmt, **options)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, path, schemas.BARS, fmt, **options)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows and unreadable lines of a text read."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


#: Folder of a store's manifest; readers of the data pass over names with an underscore.
SLICES = "_slices"
MANIFEST = T.StructType(
    [
        T.StructField("batch", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()),
        T.StructField("year", T.IntegerType()), T.StructField("first_ts", T.TimestampNTZType()),
        T.StructField("last_ts", T.TimestampNTZType()), T.StructField("rows", T.LongType()),
    ]
)


def _commits(spark: SparkSession, path: str) -> list[str]:
    """The manifest's files of a store, in the order of the commits."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{SLICES}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return [f"{path}/{SLICES}/{n}" for n in sorted(names) if n.isdigit()]


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Give a written folder its final name, in one step; False where the name is taken."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.getFileSystem(conf).getUri(), conf)
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(old, new, none)
    except Exception as error:  # noqa: BLE001  whatever the file system says, a taken name is what matters
        if "exist" in str(error).lower():
            return False
        raise
    return True


def slices(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: a row per committed (batch, symbol, tf, year), with its times and number of rows."""
    commits = _commits(spark, path.rstrip("/"))
    return spark.read.schema(MANIFEST).parquet(*commits) if commits else spark.createDataFrame([], MANIFEST)


def write_immutable(
    df: DataFrame,
    path: str,
    batch: str,
    ts: str = "bar_ts",
    keys: tuple[str, ...] = ("symbol", "tf"),
    chunk_seconds: int = 30 * 86400,
) -> None:
    """Add a batch to a store: folders by batch, keys and year. What is committed is never written again.

    Rows are shuffled by key and time chunk, so a hot symbol spreads over many
    tasks and files; each file is sorted by time for row-group skipping.

    A batch becomes visible when its slices (keys, year, first and last time, rows) enter the manifest
    by a rename, after the data. Commits are numbered, so two writers cannot take the same place, and the
    later one looks at the other's slices first. A committed batch, or a slice whose times overlap a
    committed one of the same keys, is refused. What a writer left behind without a commit is not read,
    and makes way for a new try of that batch.
    """
    path, spark = path.rstrip("/"), df.sparkSession
    if not slices(spark, path).filter(F.col("batch") == batch).isEmpty():
        raise ValueError(f"batch {batch} already exists in {path}")
    folder = f"{path}/batch={batch}"
    dated = df.withColumn("year", F.year(ts)).withColumn(
        "_chunk", F.floor(seconds(ts) / chunk_seconds)
    )
    (
        dated.repartition(*keys, "year", "_chunk")
        .sortWithinPartitions(*keys, "year", ts)
        .drop("_chunk")
        .write.partitionBy(*keys, "year")
        .mode("overwrite")
        .parquet(folder)
    )
    written = T.StructType([df.schema[ts], *[df.schema[k] for k in keys], T.StructField("year", T.IntegerType())])
    rows = spark.read.schema(written).parquet(folder)
    named = {c: F.col(c) if c in keys else F.lit(None).cast("string") for c in ("symbol", "tf")}
    own = rows.groupBy(*[v.alias(c) for c, v in named.items()], "year").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("rows")
    )
    waiting = f"{path}/{SLICES}/_{uuid.uuid4().hex}"
    own.select(F.lit(batch).alias("batch"), *MANIFEST.names[1:]).coalesce(1).write.parquet(waiting)
    while True:
        commits = _commits(spark, path)
        ours = spark.read.schema(MANIFEST).parquet(waiting).alias("a")
        theirs = (spark.read.schema(MANIFEST).parquet(*commits) if commits else spark.createDataFrame([], MANIFEST)).alias("b")
        same = F.col("a.year").eqNullSafe(F.col("b.year"))
        for k in ("symbol", "tf"):
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        meet = (F.col("a.first_ts") <= F.col("b.last_ts")) & (F.col("b.first_ts") <= F.col("a.last_ts"))
        # Rows without a time have no range; two slices of them hold the same.
        meet = F.coalesce(meet, F.col("a.first_ts").isNull() & F.col("b.first_ts").isNull())
        clash = ours.join(theirs, same).filter(meet).select("a.symbol", "a.tf", "a.year", "b.batch").first()
        if clash is not None:
            raise ValueError(f"batch {batch}: {clash.symbol} {clash.tf} {clash.year} overlaps batch {clash.batch}, which already exists")
        if _renamed(spark, waiting, f"{path}/{SLICES}/{len(commits):08d}"):
            return


def read_store(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    start: datetime | None = None,
    end: datetime | None = None,
    ts: str = "bar_ts",
) -> DataFrame:
    """The committed batches of a store as one table, with the columns batch and year.

    With start <= ts < end only batches and years that the manifest has in that time are read at all.
    """
    full = T.StructType(
        [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("year", T.IntegerType())]
    )
    path = path.rstrip("/")
    held = slices(spark, path)
    if start is not None:
        held = held.filter(F.col("last_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        held = held.filter(F.col("first_ts") < F.lit(end).cast("timestamp_ntz"))
    found = held.select("batch", "year").distinct().collect()  # the store's folders, not its rows
    batches = sorted({r.batch for r in found})
    if not batches:
        return spark.createDataFrame([], full)
    table = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in batches])
    if start is None and end is None:
        return table
    table = table.filter(F.col("year").isin(sorted({r.year for r in found if r.year is not None})))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return table.filter(inside)


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Name tables for use in `spark.sql`."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of landed files; another transport differs only in `format`."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_ticks(spark: SparkSession, path: str, **options) -> DataFrame:
    return stream_table(spark, path, schemas.TICKS, **options)


def write_audit(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append risk decisions; a stream writes each batch once through its checkpoint."""
    rows = schemas.require(df, schemas.AUDIT)
    if not df.isStreaming:
        rows.write.mode("append").parquet(path)
        return None
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_metadata(stats: DataFrame, path: str) -> None:
    """Write feature order, types and normalisation constants as JSON lines."""
    stats.write.mode("errorifexists").json(path)
