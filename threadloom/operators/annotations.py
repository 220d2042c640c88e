"""What a user says about archived messages: feedback, bookmarks, reading positions. Logs are only appended to."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("outdated", "quoted", "excluded", "corrected", "restored")
KINDS = ("statement", "preference", "plan", "event")
FEEDBACK = "id long, message_id string, action string, note string, stated_at string, valid_from string, valid_until string, assertion_kind string, replacement_message_id string"


def add_feedback(log: DataFrame, message_id: str, action: str, at: str, *, note: str = "", valid_from: str | None = None, valid_until: str | None = None, kind: str = "statement", replacement: str | None = None) -> DataFrame:
    """The log with one more entry, whose id follows the last. Outdated messages without an end end on the day of `at`."""
    if action not in ACTIONS or kind not in KINDS:
        raise ValueError("unknown action or assertion kind")
    days = [date.fromisoformat(d) for d in (valid_from, valid_until) if d]
    if len(days) == 2 and days[0] > days[1]:
        raise ValueError("valid_until must not precede valid_from")
    if action == "corrected" and not note.strip() and not replacement:
        raise ValueError("corrected feedback requires a note or a replacement message")
    if action == "outdated" and not valid_until:
        valid_until = at[:10]
    new = log.sparkSession.createDataFrame([(None, message_id, action, note, at, valid_from, valid_until, kind, replacement)], FEEDBACK)
    after = log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next"))
    return log.unionByName(new.join(F.broadcast(after)).withColumn("id", F.col("next")).drop("next"))


def bookmarks(log: DataFrame, *, key: str = "message_id", entry: str = "id", removed: str | None = "removed", topic: str | None = None, topic_col: str = "topic") -> DataFrame:
    """The last entry of each key, unless it removes the bookmark; of one topic if topic is given."""
    columns = [c for c in log.columns if c not in (key, entry)]
    last = log.groupBy(key).agg(F.max(entry).alias(entry), *[F.max_by(c, entry).alias(c) for c in columns])
    last = last.where(~F.coalesce(F.col(removed), F.lit(False))) if removed else last
    return last if topic is None else last.where(F.col(topic_col) == topic)


def positions(log: DataFrame, *, keys: tuple[str, ...] = ("snapshot_key", "conversation_id"), entry: str = "updated_at") -> DataFrame:
    """The last reading position of each snapshot and conversation."""
    columns = [c for c in log.columns if c not in (*keys, entry)]
    return log.groupBy(*keys).agg(F.max(entry).alias(entry), *[F.max_by(c, entry).alias(c) for c in columns])
