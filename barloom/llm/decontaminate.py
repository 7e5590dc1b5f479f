"""Benchmark decontamination by winnowed fingerprints, extended to whole windows.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, lean, packed, signed, unpacked, whole_text
from barloom.session import store

#: Documents are compared with windows of so many words of an item.
WINDOW = 10
#: Words of a k-gram, and k-grams of a winnowing window. A shared span of WINDOW words holds
#: just one winnowing window, whose smallest k-gram hash both sides keep.
GRAM = 6
WINNOW = WINDOW - GRAM + 1

#: Fingerprints of the benchmark that are broadcast, at most: 16 MB.
MOST_MARKS = 1_000_000

#: What lies between words once A-Z is in lower case (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), "")


def runs(length: int, size: Column) -> Column:
    """Starts of all runs of `length` out of `size` elements; null if there are fewer."""
    return F.when(size >= length, F.sequence(F.lit(0), size - length))


def joint_hashes(hashes: str, length: int) -> Column:
    starts = runs(length, F.size(hashes))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(length), *[F.col(hashes)[i + k] for k in range(length)]))


def whole_runs(hashes: str, length: int) -> Column:
    def mark(h: Column, i: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), h.alias("hash"), i.alias("first"), i.alias("last"))

    return F.transform(hashes, mark)


def fingerprints(rows: DataFrame, short: list[int], carry: bool = False) -> DataFrame:
    """The rows' columns with length, hash, first and last, from the column `words`.

    With `carry`, `words` stay beside each fingerprint: right where few are left before a shuffle.

    Winnowing: of the k-grams in each window the smallest hash is kept, once for neighbouring
    windows that keep the same; it stands for the windows that start at words first to last.
    For every length in `short`, all runs of so many words are kept as well (see `decontaminate`).
    Columns are computed step by step, and exploded in the outer form, so that Spark computes
    none of them twice.
    """
    keys = [c for c in rows.columns if carry or c != "words"]
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("grams", joint_hashes("hashes", GRAM))
    low = F.transform(
        runs(WINNOW, F.size("grams")), lambda i: F.least(*[F.col("grams")[i + k] for k in range(WINNOW)])
    )
    rows = rows.withColumn("low", low)
    turns = F.filter(
        F.sequence(F.lit(0), F.size("low") - 1), lambda i: (i == 0) | (F.col("low")[i] != F.get("low", i - 1))
    )
    rows = rows.withColumn("turns", F.when(F.col("low").isNotNull(), turns))
    kept = F.transform(
        "turns",
        lambda i, k: F.struct(
            F.lit(WINDOW).alias("length"), F.col("low")[i].alias("hash"), i.alias("first"),
            (F.coalesce(F.get("turns", k + 1), F.size("low")) - 1).alias("last"),
        ),
    )
    none = F.array().cast("array<struct<length:int,hash:bigint,first:int,last:int>>")
    rows = rows.withColumn("kept", F.coalesce(kept, none))
    for n in short:
        rows = rows.withColumn(f"runs{n}", joint_hashes("hashes", n))
        rows = rows.withColumn("kept", F.concat("kept", F.coalesce(whole_runs(f"runs{n}", n), none)))
    spread = rows.select(*keys, F.explode_outer("kept").alias("f")).where("f is not null")
    return spread.select(*keys, "f.*")


def contamination(docs: DataFrame, benchmark: DataFrame, most_marks: int = MOST_MARKS) -> DataFrame:
    """doc_id, sig, n_hit, items (ids as sorted strings): the documents with a benchmark window.

    A window is a run of WINDOW words of an item; a shorter item is one window. Both sides are
    winnowed, and the fingerprints joined: every shared window has a shared fingerprint. Each
    hit is extended to the windows it stands for, which are compared word by word. Short items
    have no winnowing window, so documents are asked for whole runs of their lengths, of which
    there are fewer than WINDOW.

    Items without words, or null texts, have no window. Items of a null id make words hit, but
    are not among `items`. Repeated items are one item.

    Sizes: the benchmark's tables are written and counted first. Up to `most_marks` distinct
    fingerprints (16 bytes each) are broadcast, so that documents are read once and only windows
    at hits are shuffled. With more, documents' fingerprints are shuffled as narrow rows, and the
    documents that are hit are read again for their words. Marks occur once each, so no hit is
    multiplied; a document's row gathers its own windows only.
    """
    items = lean(benchmark, "item_id", "text").select("item_id", words_of(whole_text()).alias("words"))
    items = store(items.withColumn("n", F.size("words")).where("n > 0"), "decon-items")
    lengths = items.where(F.col("n") < WINDOW).select("n").distinct()
    short = sorted(r.n for r in lengths.collect())  # fewer than WINDOW rows

    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))
    texts = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, WINDOW), " "))
    windows = store(items.select("item_id", F.explode_outer(texts).alias("window")).distinct(), "decon-windows")
    marks = fingerprints(items.where(F.col("n") >= WINDOW).select("words"), [])
    for n in short:
        marks = marks.unionByName(fingerprints(items.where(F.col("n") == n).select("words"), [n]))
    marks = store(marks.select("length", "hash").distinct(), "decon-marks")

    rows = signed(docs).select("doc_id", "sig", words_of(F.col("text")).alias("words"))
    if marks.count() <= most_marks:
        near = fingerprints(rows, short, carry=True).join(F.broadcast(marks), ["length", "hash"])
    else:
        hits = fingerprints(rows, short).join(marks, ["length", "hash"]).select("doc_id", "sig", "length", "first", "last")
        spans = hits.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("length", "first", "last")).alias("spans"))
        spans = store(spans.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "spans"), "decon-hits")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
        near = signed(docs).join(spans, same).select("doc_id", "sig", words_of(F.col("text")).alias("words"), "spans")
        near = near.select("doc_id", "sig", "words", F.inline("spans"))
    near = near.select(
        "doc_id", "sig", "words", "length", F.explode_outer(F.sequence("first", "last")).alias("at")
    )
    near = near.select(
        "doc_id", "sig", "length", "at", F.expr("array_join(slice(words, at + 1, length), ' ')").alias("window")
    )
    found = near.join(windows, "window").groupBy("doc_id", "sig").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    covered = F.aggregate(
        "hit",
        nothing,
        lambda acc, w: F.struct(
            F.greatest(acc["end"], w["at"] + w["length"]).alias("end"),
            (
                acc["words"] + F.greatest(w["at"] + w["length"] - F.greatest(acc["end"], w["at"]), F.lit(0))
            ).alias("words"),
        ),
        lambda acc: acc["words"],
    )
    return found.select("doc_id", "sig", covered.alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Rows repeated with one id and one text get a row each.
    """
    found = contamination(docs, benchmark)
    found = store(found.withColumnsRenamed({"doc_id": "d", "sig": "s"}), "decon-found")
    rows = signed(docs).select("doc_id", "sig", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, all columns; repeated rows stay repeated."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("sig").alias("s"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
    return unpacked(packed(docs).join(store(found, "decon-found"), same, "left_anti"), docs.columns)
