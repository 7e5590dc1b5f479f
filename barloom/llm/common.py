"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from barloom.session import prepare

#: Whole texts travel to Python in small batches, so that long ones do not add up.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the options that the text operators rely on."""
    prepare(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def lean(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column can clash with the operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names or ("doc_id", "text")])


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's 64-bit hash.

    A row is known by (doc_id, sig): rows repeated with one id and one text are the same
    document, and rows that share only the id, which may be null, stay apart.
    """
    return lean(docs).select("doc_id", whole_text().alias("text")).withColumn("sig", F.xxhash64("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["sig"] == right["sig"])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeat_rows(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row `times` times, numbered from 0; long runs are exploded in blocks."""
    block = 4096
    last = (F.col(times) - 1) / block
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(last).cast("int"))))
    left = F.least(F.lit(block), F.col(times) - F.col("_block") * block).cast("int")
    rows = blocks.withColumn("_place", F.explode(F.sequence(F.lit(0), left - 1)))
    return rows.withColumn(number, F.col("_block").cast("long") * block + F.col("_place")).drop("_block", "_place")


def hex_of(fp: Column) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, sig, text and `rest`, a struct of every column but the text."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("rest"), F.col("text").cast("string").alias("text"))
    return rows.select(F.col("rest.doc_id").alias("doc_id"), F.xxhash64(whole_text()).alias("sig"), "text", "rest")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Back from `packed` to the named columns; n_chars, where there is one, follows the text."""

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.length("text").cast(rows.schema["rest"].dataType["n_chars"].dataType).alias(name)
        return F.col("rest").getField(name).alias(name)

    return rows.select(*[column(c) for c in columns])
