"""How filters act on each other in every order, from one sum of wide integers per part.

A document is a mask of the filters it fails. Every mask has one big integer, whose fields hold
the outcome of every step of every order: one where the step removes the document, nil elsewhere.
The integers of all documents of a part are added up, and the fields of the sum are the counts.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import whole_text
from barloom.session import store

#: Filters by letter; the last one asks the whole table.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in range(len(ORDERS)) for step in range(len(FILTERS))]
#: A document fails a filter by these bounds.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bits of a field. The highest field, without an upper end, counts the documents, and no other
#: count is larger: while it is below 2^WIDTH, no field has run into the next one.
FIELD_BYTES = 6
WIDTH = 8 * FIELD_BYTES
#: Parts that a task holds sums of; beyond that it sends them on and starts anew.
HELD = 1000
#: The partial sums of a part are added up in so many tasks before the last one.
SALT = 64

#: Fields, lowest first: step outcomes of all documents, of good and of toxic ones; failures of
#: each filter, of that filter alone; documents.
N, M = len(STEPS), len(FILTERS)
ALL, GOOD, TOXIC, FAILS, ONLY, DOCS = 0, N, 2 * N, 3 * N, 3 * N + M, 3 * N + 2 * M


def row_mask(text: str) -> int:
    """Bits of the filters that look at the text alone."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: ASCII blanks only
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)
    return short | dull << 1 | loud << 2 | (SIGNS.search(data) is not None) << 3


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang, null: empty) and mask, the bits of the filters that each document fails.

    Texts are compared by their SHA-256, so that only narrow rows are shuffled; the smallest id of
    a text combines before the shuffle, and only texts with several ids meet the documents again.
    Null text counts as empty. A null id is smaller than none and has none smaller; rows that share
    id and text are not smaller than each other.
    """

    def stamp(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = pa.array([row_mask(t) for t in texts], pa.int32())
            sha = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), found, sha], names)

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    texts = docs.select("doc_id", part, whole_text().alias("text"))
    more = [T.StructField("mask", T.IntegerType()), T.StructField("sha", T.BinaryType())]
    schema = T.StructType([texts.schema["doc_id"], texts.schema["part"], *more])
    names = schema.names
    rows = store(texts.mapInArrow(stamp, schema), "audit-masks")
    ids = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = store(ids.where("first < last").select("sha", "first"), "audit-copied")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << (M - 1)).otherwise(0)
    return rows.join(copied, "sha", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def flagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and bits: 1 where a label of the id says quality 1, 2 where one says toxic 1."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"),
    )
    said = said.select("id", (F.col("good") + F.col("toxic")).alias("bits")).where("bits > 0")
    return rows.join(said, F.col("doc_id") == F.col("id"), "left").select("part", "mask", F.coalesce("bits", F.lit(0)).alias("bits"))


def outcome(mask: int, bits: int) -> int:
    """The big integer of a document."""
    fields = [DOCS]
    fails = [f for f in range(M) if mask >> f & 1]
    fields += [FAILS + f for f in fails]
    fields += [ONLY + f for f in fails if len(fails) == 1]
    for order, name in enumerate(ORDERS):
        step = next((s for s, letter in enumerate(name) if mask >> FILTERS.index(letter) & 1), None)
        if step is not None:
            at = order * M + step
            fields += [at + ALL, *[at + GOOD] * (bits & 1), *[at + TOXIC] * (bits >> 1)]
    return sum(1 << WIDTH * f for f in fields)


def as_bytes(total: int) -> bytes:
    return total.to_bytes((total.bit_length() + 7) // 8 or 1, "little")


SUMS = "part string, total binary"


def partial_sums(rows: DataFrame) -> DataFrame:
    """part and total: the sums of the integers of the rows of a task. No row is shuffled for them."""

    def add(batches):
        import pyarrow as pa

        known, sums = {}, {}

        def sent():
            columns = [pa.array(sums, pa.string()), pa.array([as_bytes(t) for t in sums.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "total"])

        for batch in batches:
            counts = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([([], "count_all")])
            for row in counts.to_pylist():
                key = (row["mask"], row["bits"])
                if key not in known:
                    known[key] = outcome(*key)
                sums[row["part"]] = sums.get(row["part"], 0) + row["count_all"] * known[key]
            if len(sums) > HELD:
                yield sent()
                sums.clear()
        yield sent()

    return rows.select("part", "mask", "bits").mapInArrow(add, SUMS)


def added(sums: DataFrame, *keys: str) -> DataFrame:
    """The totals of each part added up where they lie, sorted by the keys: a running sum in each task."""

    def add(batches):
        import pyarrow as pa

        part, total = None, 0
        for batch in batches:
            ends = []
            for name, data in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
                if name != part and part is not None:
                    ends.append((part, as_bytes(total)))
                    total = 0
                part, total = name, total + int.from_bytes(data, "little")
            if ends:
                yield pa.RecordBatch.from_pydict({"part": [e[0] for e in ends], "total": [e[1] for e in ends]})
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "total": [as_bytes(total)]})

    return sums.repartition(*keys).sortWithinPartitions(*keys).select("part", "total").mapInArrow(add, SUMS)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def unpacked(sums: DataFrame) -> DataFrame:
    """A row per part, order and step from the fields of each part's sum."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        which = np.array([FILTERS.index(ORDERS[order][step]) for order, step in STEPS])
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
                total = int.from_bytes(data, "little")
                docs = total >> DOCS * WIDTH
                if docs >> WIDTH:
                    raise OverflowError(f"a part has 2^{WIDTH} documents or more")
                raw = np.frombuffer(total.to_bytes((DOCS + 1) * FIELD_BYTES, "little"), np.uint8).reshape(-1, FIELD_BYTES)
                field = np.pad(raw, ((0, 0), (0, 8 - FIELD_BYTES))).copy().view("<i8")[:, 0]
                removed = field[ALL : ALL + N]
                columns = {
                    "kept": docs - removed.reshape(-1, M).cumsum(1).ravel(), "removed": removed,
                    "redundant": field[FAILS + which] - removed, "unique_fails": field[ONLY + which],
                    "good_lost": field[GOOD : GOOD + N], "toxic_lost": field[TOXIC : TOXIC + N],
                    "shapley": np.array([removed[which == f].sum() for f in range(M)])[which],
                }
                names = {"part": [part] * N, "filter_order": [ORDERS[o] for o, _ in STEPS]}
                steps = {"step": pa.array([s + 1 for _, s in STEPS], pa.int32())}
                yield pa.RecordBatch.from_pydict(names | steps | {c: pa.array(v.astype(np.int64)) for c, v in columns.items()})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return sums.mapInArrow(read, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of what happens there, for every order of the filters.

    A task sends one integer (11 kB) per part; those of a part are added up in SALT tasks and then in
    one, so a part that holds most rows is no longer work than any other. Several labels of one id
    count as one that has what any of them says. A null id has no label. No documents: no rows.
    """
    rows = flagged(masks(docs), labels)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALT))
    sums = added(partial_sums(rows).withColumn("salt", salt), "part", "salt")
    return unpacked(added(sums, "part"))
