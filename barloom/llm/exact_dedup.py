"""Exact de-duplication by a 128-bit content hash and a byte comparison within each hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lean, repeat_rows, whole_text
from barloom.session import store

#: Texts are equal when they agree after each run of these becomes one space (fixed values).
BLANKS = r"[\x20\x09-\x0D]+"


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, hash128: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping by (hash, text) compares the bytes: the rows of a hash meet in one task only as
    distinct texts, since copies melt in each task before the shuffle. Every distinct text of a
    hash is numbered, so that texts that share a hash stay apart; the ids then meet their group
    in a join over narrow rows, which Spark splits where one group is large.

    Null text counts as empty, and the empty text forms a group like any other. A null doc_id
    is the smallest id only where no other exists. Where the smallest id occurs on several rows
    of a group, one of them is kept.
    """
    texts = lean(docs).select("doc_id", F.regexp_replace(whole_text(), BLANKS, " ").alias("text"))
    hashed = texts.withColumn("h", hash128(F.col("text")))

    def groups_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    sha = F.sha2("text", 256).alias("sha")
    groups = store(groups_of(hashed).select("h", "keep_id", "group_size", sha), "exact-groups")
    shared = store(groups.groupBy("h").count().where("count > 1").select("h"), "exact-shared-hashes")

    # The usual case: one text per hash. Neither side carries the text.
    rows = hashed.groupBy("h", "doc_id").agg(F.count("*").alias("times"))
    found = rows.join(groups.join(shared, "h", "left_anti"), "h").drop("h")
    if not shared.isEmpty():
        clash = hashed.join(shared, "h", "left_semi")
        apart = clash.groupBy("h", "text", "doc_id").agg(F.count("*").alias("times"))
        mixed = groups_of(clash).withColumn("sha", sha)
        found = found.unionByName(apart.join(mixed, ["h", "text"]).drop("h", "text"))
    return repeat_rows(found, "times", "copy").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
