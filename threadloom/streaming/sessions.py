"""Streaming: session logs into a table, exactly once, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.sources.logs import append_entries, parse_entries
from threadloom.sources.tailing import growing_lines


def _append(table_path: str):
    """A foreachBatch function: new entries of a batch of lines (file, value) into a Parquet table, each once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = parse_entries(batch).dropDuplicates(["file", "id", "raw_sha256"])
        if not new.groupBy("file", "id").count().where("count > 1").isEmpty():
            raise ValueError("one id has two entries")
        try:
            known = spark.read.parquet(table_path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = new.limit(0)
        fresh, conflicts = append_entries(known, new)
        if not conflicts.isEmpty():
            raise ValueError("an entry that was read before has changed")
        fresh.write.mode("append").parquet(table_path)

    return write


def append_sessions(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the entries of new (rotated, closed) log files below folder to a Parquet table. An entry that is there
    already is passed over, so that a repeated batch adds nothing; changed history stops the query."""
    lines = spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.writeStream.foreachBatch(_append(table_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_growing_sessions(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """As append_sessions, for logs that are still written: each run reads what whole lines were appended since the last (see
    sources.tailing). A half-written last line waits; a whole line that is no JSON stops the query, as changed history does."""
    lines = growing_lines(spark, folder)
    append = _append(table_path)

    def write(batch: DataFrame, number: int) -> None:
        if not batch.where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).isEmpty():
            raise ValueError("a whole line of a log is no JSON")
        append(batch.select("file", "value"), number)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time_col: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, key, n over a stream or a table; a stream drops what comes later than `late`."""
    kept = events.withWatermark(time_col, late) if events.isStreaming else events
    at = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return kept.groupBy(at.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
