"""Distributions and activity over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def activity_by_month(rows: DataFrame, at: Column, thread: str) -> DataFrame:
    """month, messages, threads (exact distinct)."""
    return rows.where(at.isNotNull()).groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("messages"), F.count_distinct(thread).alias("threads"))


def activity_by_year(months: DataFrame) -> DataFrame:
    """year, messages, threads_month_sum: a sum of the months' distinct counts, not a year's distinct count."""
    return months.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.sum("messages").alias("messages"), F.sum("threads").alias("threads_month_sum"))


def distribution(rows: DataFrame, key: Column, name: str, missing: str = "unlabeled") -> DataFrame:
    """name, n: rows by key, null keys under one label."""
    return rows.groupBy(F.coalesce(key, F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def first_json_text(payload: Column, paths: list[str]) -> Column:
    """The first of the JSON values at paths that is a text with something in it, trimmed."""
    variant = F.try_parse_json(payload)
    values = [F.when(F.schema_of_variant(F.try_variant_get(variant, p, "variant")) == "STRING", F.nullif(F.trim(F.get_json_object(payload, p)), F.lit(""))) for p in paths]
    return F.coalesce(*values)


def status_counts(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """key, total, and n_<value> for each value."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values])


def pivot_counts(rows: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """keys and a count for each of the given values, 0 where there is none."""
    return rows.groupBy(*keys).pivot(column, values).count().na.fill(0, values)


def complete_sum(column: str) -> Column:
    """The sum of a column, null if any value is missing."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))
