"""Line logs: agent sessions and interchange events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_ENTRY = "type string, id string, parentId string, timestamp string, message struct<role:string,content:string,timestamp:double>"
#: The fields of an interchange event and its kinds.
EVENT_FIELDS = ("schema", "event_id", "provider", "identity_scope", "snapshot_id", "kind", "thread_native_id", "native_id", "observed_at", "payload", "raw_payload")
EVENT_KINDS = ("thread", "node", "message", "asset", "absence")
MAX_LINE = 16 * 1024 * 1024


def session_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, type, id, parent, role, text, raw_sha256 of the entries of session logs. A last line without a line end is still
    being written and left for the next reading; any other line that is no JSON stops the query."""
    lines = spark.read.format("text").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    # A split may end anywhere, so that a file's bytes tell whether its last line has an end: they are one more than without.
    whole = lines.groupBy("file").agg((F.sum(F.octet_length("value") + 1) <= F.max("size")).alias("ended"))
    broken = lines.where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).groupBy("file").agg(F.count("*").alias("n")).join(whole, "file")
    if not broken.where((F.col("n") > 1) | F.col("ended")).isEmpty():
        raise ValueError("a line that isn't the last one of its file is no JSON")
    return parse_entries(lines)


def parse_entries(lines: DataFrame) -> DataFrame:
    entry = F.from_json("value", SESSION_ENTRY)
    valid = lines.where(F.try_parse_json("value").isNotNull()).withColumn("e", entry)
    parts = F.from_json("e.message.content", "array<struct<type:string,text:string>>")
    text = F.when(F.startswith(F.ltrim(F.col("e.message.content")), F.lit("[")), F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")).otherwise(F.col("e.message.content"))
    return valid.select("file", F.col("e.type").alias("type"), F.col("e.id").alias("id"), F.col("e.parentId").alias("parent"), F.col("e.message.role").alias("role"), text.alias("text"), F.sha2("value", 256).alias("raw_sha256"))


def append_entries(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to append, conflicts): an entry that is there with other content is a conflict, never replaced."""
    known = existing.select("file", "id", F.col("raw_sha256").alias("known"))
    both = new.join(known, ["file", "id"], "left")
    return both.where("known IS NULL").drop("known"), both.where("known IS NOT NULL AND known <> raw_sha256").drop("known")


def interchange_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each line of interchange files with its fields and problem: null, or what is wrong with it.

    A line must be a JSON object with exactly the known fields, a known kind, an id that no other line has, and no more
    than MAX_LINE bytes."""
    shape = ", ".join(f"{f} string" for f in EVENT_FIELDS)
    lines = spark.read.text(paths).withColumn("e", F.from_json("value", shape)).withColumn("keys", F.array_sort(F.json_object_keys("value")))
    problem = (
        F.when(F.octet_length("value") > MAX_LINE, "too_long")
        .when(F.try_parse_json("value").isNull() | F.col("keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, EVENT_FIELDS)))) > 0, "unknown_field")
        .when(~F.array_contains("keys", "event_id") | ~F.array_contains("keys", "kind"), "missing_field")
        .when(~F.col("e.kind").isin(*EVENT_KINDS), "unknown_kind")
    )
    rows = lines.select("e.*", problem.alias("problem"))
    twice = rows.where("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("__n")).where("__n > 1")
    return rows.join(twice, "event_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("__n").isNotNull(), "duplicate_id"))).drop("__n")


def event_counts(events: DataFrame) -> DataFrame:
    return events.where("problem IS NULL").groupBy("provider", "kind").agg(F.count("*").alias("n"))


def compare_replays(first: DataFrame, second: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """keys, state of rows that only one of two recovery runs has, or whose fingerprints differ."""
    a, b = first.select(*keys, F.col(fingerprint).alias("a"), F.lit(True).alias("in_a")), second.select(*keys, F.col(fingerprint).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "only_first").when(F.col("in_a").isNull(), "only_second").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).where("state IS NOT NULL")
