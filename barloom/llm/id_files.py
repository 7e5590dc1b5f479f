"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import signed
from barloom.llm.tokens import worker_encoder
from barloom.session import store

END = 2
#: Words whose ids a worker remembers; the job holds little else.
REMEMBERED = 800_000
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000

#: What ORC is told: stripes that tasks can read on their own, an index entry per INDEX_ROWS
#: rows, and Bloom filters that let a look-up pass over stripes and row groups.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(STRIPE_BYTES),
    "orc.create.index": "true",
    "orc.row.index.stride": str(INDEX_ROWS),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def file_schema(doc_id: T.StructField) -> T.StructType:
    """part: the file's place in the order; first: ids of the part before this document."""
    return T.StructType(
        [
            doc_id, T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )


def write_ids(docs: DataFrame, path: str, spec: str, end: int = END) -> None:
    """Encode whole texts, each with the end id, and write them in ascending order of doc_id.

    Documents are dealt by ranges of (doc_id, text hash), so that even rows that share an id,
    null ids among them, spread over tasks, and sorted within; a null id comes first. Text is
    shuffled, not ids, which take more room. ORC encodes the ids as integer runs. Null and empty
    texts are the end id alone; repeated rows are written once each.
    """
    schema = file_schema(docs.schema["doc_id"])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, tail, first = worker_encoder(spec, REMEMBERED), np.array([end], "<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = [x + tail for x in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            arrays = [
                batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(first + ends - sizes),
                pa.array(sizes), pa.ListArray.from_arrays(offsets, values),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
            first += int(sizes.sum())

    order = ["doc_id", "sig"]
    rows = signed(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(run, schema).write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; stripes are read in parallel.

    The parts' sizes come from narrow columns. There is one row per part, written before it meets
    the ids, so that Spark knows how small the table is and need not shuffle them.
    """
    rows = spark.read.orc(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    start = (F.col("before") + F.col("first")).alias("start")
    return rows.join(store(sizes, "id-parts"), "part").select("doc_id", start, "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; ORC skips what index and Bloom filter rule out."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32, of the ids as little-endian unsigned 32-bit integers, instead of ids."""
    names = [c for c in rows.columns if c != "ids"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            data, ends = np.asarray(ids.flatten()).astype("<u4"), np.asarray(ids.offsets)
            ends = ends - ends[0]
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(crc, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
