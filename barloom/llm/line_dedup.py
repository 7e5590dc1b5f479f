"""Line de-duplication over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import packed
from barloom.session import store

WIDTH = 3
#: Lines are equal when they agree without these characters at either end (fixed values).
TRIMMED = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def filled(lines: Column) -> Column:
    """Positions of the lines that are not blank."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.filter(places, lambda i: F.btrim(lines[i], F.lit(TRIMMED)) != "")


def windows(rows: DataFrame) -> DataFrame:
    """doc_id, sig, start and the window's 128-bit hash (h1, h2): every run of three lines.

    `start` counts the lines that are not blank.
    """
    trimmed = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: x != "")
    lines = rows.select("doc_id", "sig", trimmed.alias("lines"))

    def hashes(i: Column) -> Column:
        three = [F.col("lines")[i + k] for k in range(WIDTH)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2"))

    starts = F.when(F.size("lines") >= WIDTH, F.sequence(F.lit(0), F.size("lines") - WIDTH))
    # The outer form: Spark adds no filter that would compute the windows twice.
    spread = lines.select("doc_id", "sig", F.posexplode_outer(F.transform(starts, hashes)).alias("start", "w"))
    return spread.where("start is not null").select("doc_id", "sig", "start", "w.h1", "w.h2")


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove every line that lies in a later occurrence of a repeated window.

    Returns a row per document: doc_id, text (without those lines), rest (the other columns, see
    `common.unpacked`), n_lines, n_removed (of the lines that are not blank) and removed (their
    positions among all lines of the text).

    A window's first occurrence is the smallest (doc_id, text hash, start); a null doc_id comes
    before all others. Blank lines belong to no window and stay. A text of fewer than three
    filled lines has no window and stays whole, as do null and empty texts. Rows repeated with
    one id and one text are the same occurrence, and get the same result. The first place of
    each distinct line is never removed, so no line is lost from the corpus.

    The windows are counted before the shuffle; only windows seen twice or more meet the
    documents' windows again, in a join whose large side Spark may split under a hot window.
    """
    rows = packed(docs)
    place = F.struct("doc_id", "sig", "start")
    seen = windows(rows).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeated = store(seen.where("n > 1").select("h1", "h2", "first"), "line-repeated")

    later = windows(rows).join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    starts = starts.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "starts")

    found = rows.join(starts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s")), "left")
    found = found.withColumn("lines", lines_of(F.col("text"))).withColumn("filled", filled(F.col("lines")))
    covered = F.flatten(
        F.transform("starts", lambda s: F.array(*[F.col("filled")[s + k] for k in range(WIDTH)]))
    )
    found = found.withColumn("removed", F.coalesce(F.array_distinct(covered), F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    rebuilt = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    result = F.struct(
        F.when(F.size("removed") == 0, F.col("text")).otherwise(rebuilt).alias("text"),
        F.size("filled").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
    )
    # The generator keeps later filters from being pushed into the steps above, where they would
    # compute the lines again for each line.
    return found.select("doc_id", F.inline_outer(F.array(result)), "rest")


def without_emptied(found: DataFrame) -> DataFrame:
    """The documents that have a line left, or never had one."""
    return found.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
