"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import credentials, jaccard, lines, packing
from threadloom.llm.shared import shared_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go; so do null and empty texts, which have no words. Rows that repeat count
    each and stay or go together. Documents of any length are read whole; an empty table stays empty."""
    return lines.quality_rules(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: boilerplate lines of a source go; n_chars follows the text. Null texts stay null (n_chars too), a null source
    is a source of its own, rows that repeat stay; a text that is nothing but boilerplate stays as an empty one."""
    return lines.drop_frequent_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents that shingles of five words link at a similarity of 0.8 or more, one stays: the
    least id. Null and empty texts, and rows with a null id, all stay; of rows that repeat id and text, one stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets give way to a mark; n_chars follows the text. Null and empty texts stay as they are."""
    return credentials.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a place in a batch for every row that is left; null and empty texts have 0 tokens, ties go by hash."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]

#: Dynamic programming has no SQL; tests hold the ids that run() keeps, and each operator by itself, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
