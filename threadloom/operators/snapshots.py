"""Snapshot and version operators: an observation says that a snapshot saw an identity at a version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order. Spark keeps n rows a group before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose key isn't there yet, one for each key."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with the rows of new in place of those with the same key."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def decompose(records: DataFrame, identity: str, payload_hash: str, snapshot: str, payload: Sequence[str]) -> dict[str, DataFrame]:
    """identities, versions (identity and payload hash, payload once) and observations of records seen in snapshots."""
    return {
        "identities": records.select(identity).distinct(),
        "versions": records.select(identity, payload_hash, *payload).dropDuplicates([identity, payload_hash]),
        "observations": records.select(snapshot, identity, payload_hash).distinct(),
    }


def numbered(snapshots: DataFrame, snapshot: str, order: str) -> DataFrame:
    """snapshot, k: the captures, one row each, numbered from 1 in their order (then by key)."""
    return snapshots.select(F.col(snapshot).alias("snapshot"), F.col(order).alias("at")).distinct().select("snapshot", F.row_number().over(Window.orderBy("at", "snapshot")).alias("k"))


def presence_runs(observations: DataFrame, snapshots: DataFrame, *, snapshot: str = "snapshot", identity: str = "identity", order: str = "captured_at") -> DataFrame:
    """identity, state, first, last: one row for each run of captures, numbered from 1, in which an identity is present, or absent
    after it was seen.

    Islands of an identity's own sightings and the gaps between and after them: no identity is joined with captures that it
    isn't in, so that the rows follow the changes, not identities times captures. Repeated observations count once;
    observations of unknown snapshots count nowhere; a null identity is one."""
    captures = numbered(snapshots, snapshot, order)
    total = F.max("k").over(Window.partitionBy())
    seen = observations.select(F.col(identity).alias("identity"), F.col(snapshot).alias("snapshot")).distinct().join(captures.select("snapshot", "k", total.alias("total")), "snapshot")
    own = Window.partitionBy("identity").orderBy("k")
    runs = seen.withColumn("island", F.col("k") - F.row_number().over(own)).groupBy("identity", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("total").alias("total"))
    ahead = F.coalesce(F.lead("first").over(Window.partitionBy("identity").orderBy("first")) - 1, F.col("total"))
    pair = F.array(F.struct(F.lit("present").alias("state"), F.col("first"), F.col("last")), F.struct(F.lit("absent").alias("state"), (F.col("last") + 1).alias("first"), F.col("until").alias("last")))
    both = runs.withColumn("until", ahead).select("identity", F.inline(pair)).where(F.col("first") <= F.col("last"))
    return both.select(F.col("identity").alias(identity), "state", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def source_absences(observations: DataFrame, snapshots: DataFrame, *, snapshot: str = "snapshot", identity: str = "identity", order: str = "captured_at") -> DataFrame:
    """snapshot, identity, prior_snapshot: every snapshot that lacks an identity which an earlier one has, and the last that
    has it; repeated until the identity comes back. The runs of absence, written out by snapshot."""
    captures = numbered(snapshots, snapshot, order)
    gone = presence_runs(observations, snapshots, snapshot=snapshot, identity=identity, order=order).where("state = 'absent'")
    listed = gone.select(F.col(identity).alias("identity"), (F.col("first") - 1).alias("before"), F.explode(F.sequence("first", "last")).alias("k"))
    named = listed.join(captures, "k").join(captures.select(F.col("k").alias("before"), F.col("snapshot").alias("prior_snapshot")), "before")
    return named.select(F.col("snapshot").alias(snapshot), F.col("identity").alias(identity), F.col("prior_snapshot").alias(f"prior_{snapshot}"))


def snapshot_deltas(observations: DataFrame, snapshots: DataFrame, *, snapshot: str = "snapshot", identity: str = "identity", version: str = "version", order: str = "captured_at") -> DataFrame:
    """snapshot, added, changed, absent: added and changed against the snapshot before, absent by source_absences."""
    ordered = snapshots.select(F.col(snapshot), F.lag(snapshot).over(Window.orderBy(order, snapshot)).alias("previous"))
    now = observations.select(snapshot, F.col(identity).alias("identity"), F.col(version).alias("now")).join(ordered, snapshot)
    then = observations.select(F.col(snapshot).alias("previous"), F.col(identity).alias("identity"), F.col(version).alias("then"), F.lit(True).alias("was"))
    both = now.where(F.col("previous").isNotNull()).join(then, ["previous", "identity"], "left")
    counts = both.groupBy(snapshot).agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("was") & ~F.col("now").eqNullSafe(F.col("then"))).alias("changed"))
    gone = source_absences(observations, snapshots, snapshot=snapshot, identity=identity, order=order).groupBy(snapshot).agg(F.count("*").alias("absent"))
    zero = F.lit(0).cast("long")
    out = snapshots.select(snapshot).join(counts, snapshot, "left").join(gone, snapshot, "left")
    return out.select(snapshot, *[F.coalesce(c, zero).alias(c) for c in ("added", "changed", "absent")])


def presence_history(observations: DataFrame, snapshots: DataFrame, identities: DataFrame, *, snapshot: str = "snapshot", identity: str = "identity", order: str = "captured_at") -> DataFrame:
    """identity, snapshot, state of every given identity at every snapshot: present, absent_in_snapshot (seen before) or
    unknown. Runs, and those before the first sighting, written out by snapshot."""
    captures = numbered(snapshots, snapshot, order)
    asked = identities.select(F.col(identity).alias("identity")).distinct()
    runs = presence_runs(observations, snapshots, snapshot=snapshot, identity=identity, order=order).withColumnRenamed(identity, "identity")
    runs = runs.join(asked, runs["identity"].eqNullSafe(asked["identity"]), "left_semi")
    first = runs.groupBy("identity").agg(F.min("first").alias("since"))
    before = asked.join(first, asked["identity"].eqNullSafe(first["identity"]), "left").select(asked["identity"], F.lit("unknown").alias("state"), F.lit(1).cast("long").alias("first"), F.coalesce(F.col("since") - 1, F.lit(captures.count())).cast("long").alias("last"))
    states = F.when(F.col("state") == "absent", "absent_in_snapshot").otherwise(F.col("state"))
    every = runs.unionByName(before).where(F.col("first") <= F.col("last")).select("identity", states.alias("state"), F.explode(F.sequence("first", "last")).alias("k"))
    return every.join(captures, "k").select(F.col("identity").alias(identity), F.col("snapshot").alias(snapshot), "state")


def update_summary(before: DataFrame, after: DataFrame, identity: str, version: str) -> DataFrame:
    """One row: added, updated, unchanged, not_present, from the latest versions of two states."""
    a = before.select(identity, F.col(version).alias("a"), F.lit(True).alias("in_a"))
    b = after.select(identity, F.col(version).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, identity, "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(
        F.count_if(F.col("in_a").isNull()).alias("added"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~same).alias("updated"),
        F.count_if(F.col("in_a") & F.col("in_b") & same).alias("unchanged"),
        F.count_if(F.col("in_b").isNull()).alias("not_present"),
    )


def current_feedback(log: DataFrame, key: str, entry: str, action: str, cancel: str = "restored") -> DataFrame:
    """The last entry of each key of an append-only log, unless it cancels."""
    last = log.groupBy(key).agg(F.max(entry).alias(entry), F.max_by(action, entry).alias(action))
    return last.where(F.col(action) != cancel)


def state_digest(rows: DataFrame, columns: Sequence[str], group: str, bits: int = 12) -> DataFrame:
    """group, digest: SHA-256 over a group's sorted row hashes; the order of rows doesn't count.

    Rows are hashed in 2**bits ranges of their hash, each a small task's work, and the ranges' digests once more, so that no
    task holds a group."""
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    hashed = rows.select(group, F.sha2(F.concat_ws("|", *parts), 256).alias("h"))
    ranges = hashed.groupBy(group, F.substring("h", 1, bits // 4).alias("r")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"])
    return ranges.groupBy(group).agg(F.sha2(F.concat_ws("", ordered), 256).alias("digest"))


def snapshot_list(snapshots: DataFrame, counted: dict[str, DataFrame], *, snapshot: str = "snapshot", order: str = "captured_at") -> DataFrame:
    """snapshots, newest first, with a column for each of counted: its rows of the snapshot, 0 without any."""
    out = snapshots
    for name, rows in counted.items():
        out = out.join(rows.groupBy(snapshot).agg(F.count("*").alias(name)), snapshot, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.orderBy(F.desc(order), F.desc(snapshot))


def snapshot_quality(diagnostics: DataFrame, absences: DataFrame, coverage: DataFrame, *, snapshot: str = "snapshot") -> DataFrame:
    """snapshot, area, key, n, size_bytes: diagnostics by severity, absences by kind of entity, files by class and handling."""
    zero = F.lit(0).cast("long")
    one = diagnostics.groupBy(snapshot, F.col("severity").alias("key")).agg(F.count("*").alias("n")).select(snapshot, F.lit("diagnostics").alias("area"), "key", "n", zero.alias("size_bytes"))
    two = absences.groupBy(snapshot, F.col("entity_kind").alias("key")).agg(F.count("*").alias("n")).select(snapshot, F.lit("source_absences").alias("area"), "key", "n", zero.alias("size_bytes"))
    key = F.concat_ws("/", "media_class", "handling_status")
    three = coverage.groupBy(snapshot, key.alias("key")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), zero).alias("size_bytes")).select(snapshot, F.lit("coverage").alias("area"), "key", "n", "size_bytes")
    return one.unionByName(two).unionByName(three)


def citation(messages: DataFrame, source_id: str, *, source: str = "source_id") -> DataFrame:
    """snapshot_key, conversation_id, message_id of one source: a key filter that reaches the scan. Ids of sessions (pi:n)
    are told apart by their prefix, in the column itself."""
    if not str(source_id).strip():
        raise ValueError("a source id is needed")
    return messages.where(F.col(source).cast("string") == str(source_id)).select("snapshot_key", "conversation_id", "message_id")


def digest_changes(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """group, state (added, removed, changed) of groups whose digests of two states differ."""
    a, b = before.select(group, F.col("digest").alias("a")), after.select(group, F.col("digest").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, group, "full_outer").select(group, state.alias("state")).where(F.col("state").isNotNull())
