"""The corpus pipeline: documents that pass quality rules, once each, without benchmark passages and secrets, packed into sequences."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemill.llm import decontam, packing, quality_rules, secrets, simhash  # noqa: E402
from tidemill.llm._spark import new_path  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; rows that repeat share their fate; an empty table stays empty."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of 0.8 or more over five-word shingles): the one of the smallest id.

    Texts without words, null ones too, are one group. Rows that repeat an id and a text are one document and stay together. Rows
    without an id stay only where their group has none.
    """
    return simhash.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage: no ten consecutive words of an item, nor a shorter item whole. Null texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew (null for a null text); repeated rows stay."""
    return secrets.redact(docs, secrets.train(secrets.samples(docs))).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is its end id; ids may repeat or be null."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", secret_scan), ("best-fit packing", pack)]

#: Tokenising and SimHash can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
