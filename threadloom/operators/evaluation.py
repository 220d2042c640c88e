"""Evaluation of retrieval: which labelled sources the hits of a case's queries hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_anchors(evidence: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Labels whose message is gone, or no longer holds the quote in a user's words; an evaluation with any is void."""
    said = messages.where("role = 'user'").select(*keys, F.col("text").alias("__text"))
    sound = evidence.join(said, keys).where(F.contains("__text", F.col("quote"))).select("case_id", *keys, "quote")
    return evidence.join(sound, ["case_id", *keys, "quote"], "left_anti")


def source_recall(cases: DataFrame, evidence: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """case_id, n_evidence, n_found, source_recall (null without labels), empty_result."""
    found = evidence.select("case_id", *keys).distinct().join(hits.select("case_id", *keys).distinct().withColumn("f", F.lit(1)), ["case_id", *keys], "left")
    per = found.groupBy("case_id").agg(F.count("*").alias("n_evidence"), F.count("f").alias("n_found"))
    any_hit = hits.select("case_id").distinct().withColumn("any", F.lit(True))
    zero = F.lit(0).cast("long")
    out = cases.select("case_id").join(per, "case_id", "left").join(any_hit, "case_id", "left")
    return out.select("case_id", F.coalesce("n_evidence", zero).alias("n_evidence"), F.coalesce("n_found", zero).alias("n_found"), F.try_divide("n_found", "n_evidence").alias("source_recall"), F.col("any").isNull().alias("empty_result"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("cases"), F.count_if(F.col("n_evidence") > 0).alias("positive_cases"), F.count_if(F.col("source_recall") == 1).alias("all_sources_found"), F.count_if(F.col("n_evidence") == 0).alias("no_record_cases"), F.count_if((F.col("n_evidence") == 0) & F.col("empty_result")).alias("empty_no_record_cases"))
