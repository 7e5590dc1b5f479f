"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept. Results are written as Parquet to the
cluster's shared folder and read again, so a lost executor costs no more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, line_dedup, near_copies, packing, quality, tokens
from barloom.llm.common import read, ready, unpacked
from barloom.llm.queries import tokenizer_file
from barloom.session import store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go. It is fitted on the stage's own input."""
    ready(spark)
    return quality.keep_good(docs, quality.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages of three lines go; n_chars follows the text.

    A document that loses its last line goes as well: all of it stands elsewhere.
    """
    ready(spark)
    return unpacked(line_dedup.without_emptied(line_dedup.line_dedup(docs)), docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Near-duplicates agree in 0.8 or more of their five-word shingles. Their 64-bit SimHashes differ
    in up to 17 bits, too many to look them up by, so MinHash bands propose the pairs.
    """
    ready(spark)
    return near_copies.near_keep(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ready(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of documents and their places in sequences."""
    ready(spark)
    return packing.pack(docs, tokens.read_spec(tokenizer_file()))


#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", pack_stage),
]

#: SQL states neither the trained classifier nor the packing; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written and read again."""
    docs = read(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
