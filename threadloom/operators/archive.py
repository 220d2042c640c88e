"""Questions to an archive: library, search, conversation lists and details, distributions, coverage and claims.

An archive is a dict of DataFrames as sources.exports.import_snapshots makes them, with `snapshots` (snapshot,
captured_at) beside them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import contains_ascii_folded, media_class, ratio
from threadloom.operators.analytics import first_json_text
from threadloom.operators.graph import branch_points, sibling_repeats
from threadloom.operators.search import matches
from threadloom.operators.snapshots import latest_by, snapshot_deltas, source_absences

Archive = Mapping[str, DataFrame]
#: Where a message may name its model, in order.
MODEL_PATHS = ["$.metadata.model_slug", "$.metadata.model_name", "$.model_slug"]


def observed_messages(t: Archive) -> DataFrame:
    """Messages as the snapshots saw them, with node, role, text and payload."""
    versions = t["message_versions"].select("conversation", "message", "raw_sha256", "author_role", "content_type", "create_time", "text", F.col("raw_json").alias("payload"))
    return t["message_observations"].join(versions, ["conversation", "message", "raw_sha256"])


def observed_conversations(t: Archive) -> DataFrame:
    versions = t["conversation_versions"].select("conversation", "raw_sha256", "title", "create_time", "update_time")
    return t["conversation_observations"].join(versions, ["conversation", "raw_sha256"]).join(t["snapshots"], "snapshot")


def latest_conversations(t: Archive) -> DataFrame:
    """The last observation of every conversation, those missing from later snapshots included."""
    return latest_by(observed_conversations(t), ["conversation"], [F.desc("captured_at"), F.desc("snapshot")])


def library(t: Archive, query: str = "") -> DataFrame:
    """Latest conversations whose title, or any message they have in that snapshot, holds query; newest first."""
    rows, query = latest_conversations(t), query.strip()
    if len(query) > 512:
        raise ValueError("the query is too long")
    if query:
        hits = observed_messages(t).where(matches(F.col("text"), query)).select("snapshot", "conversation").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(hits, ["snapshot", "conversation"], "left").where(F.coalesce("hit", F.lit(False)) | contains_ascii_folded(F.col("title"), query)).drop("hit")
    return rows.orderBy(F.desc(F.coalesce("update_time", "create_time", F.lit(0.0))), "conversation")


def recent_messages(t: Archive) -> DataFrame:
    """Messages on the current branch of each conversation's last observation."""
    last = latest_conversations(t).select("snapshot", "conversation", "title")
    branch = t["current_branch"].join(last, ["snapshot", "conversation"])
    return observed_messages(t).join(branch, ["snapshot", "conversation", "node"])


def list_conversations(t: Archive, snapshot: str) -> DataFrame:
    """A snapshot's conversations with nodes, messages, branch points, alternatives, a preview, and whether a later snapshot
    lacks them."""
    here = F.col("snapshot") == snapshot
    nodes = t["node_observations"].where(here)
    counts = nodes.groupBy("conversation").agg(F.count("*").alias("nodes"), F.count("message").alias("messages"))
    forks = branch_points(nodes, group="conversation", parent="parent")
    said = observed_messages(t).where(here & (F.length(F.trim("text")) > 0)).join(t["current_branch"], ["snapshot", "conversation", "node"])
    preview = said.groupBy("conversation").agg(F.min_by("text", F.struct((F.col("author_role") != "user").alias("other"), "depth")).alias("preview"))
    gone = source_absences(t["conversation_observations"], t["snapshots"], identity="conversation").join(t["snapshots"], "snapshot")
    when = t["snapshots"].where(here).select(F.col("captured_at").alias("this"))
    later = gone.join(F.broadcast(when)).where("captured_at > this").select("conversation", F.lit(True).alias("absent_later")).distinct()
    out = observed_conversations(t).where(here).join(counts, "conversation", "left").join(forks, "conversation", "left").join(preview, "conversation", "left").join(later, "conversation", "left")
    zero = F.lit(0).cast("long")
    return out.select("conversation", "title", "create_time", "update_time", *[F.coalesce(c, zero).alias(c) for c in ("nodes", "messages", "branch_points", "alternatives")], "preview", F.coalesce("absent_later", F.lit(False)).alias("absent_later")).orderBy(F.desc(F.coalesce("update_time", "create_time", F.lit(0.0))), "conversation")


def conversation_detail(t: Archive, snapshot: str, conversation: str) -> DataFrame:
    """One conversation's nodes: the current branch by depth, then the others by name, with children and message."""
    here = (F.col("snapshot") == snapshot) & (F.col("conversation") == conversation)
    nodes = t["node_observations"].where(here)
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))
    branch = t["current_branch"].where(here).select("node", "depth")
    said = observed_messages(t).where(here).select("node", "author_role", "content_type", "create_time", "text")
    out = nodes.select("node", "parent", "message").join(children, "node", "left").join(branch, "node", "left").join(said, "node", "left")
    return out.withColumn("on_current_branch", F.col("depth").isNotNull()).orderBy(F.asc_nulls_last("depth"), "node")


def model(payload: Column) -> Column:
    return first_json_text(payload, MODEL_PATHS)


def branch_analytics(t: Archive, snapshot: str) -> DataFrame:
    """One row: conversations, branch_points, alternatives, branched_conversations, branch_rate, regenerated, edited."""
    here = F.col("snapshot") == snapshot
    nodes = t["node_observations"].where(here)
    forks = branch_points(nodes, group="conversation", parent="parent").agg(F.coalesce(F.sum("branch_points"), F.lit(0)).alias("branch_points"), F.coalesce(F.sum("alternatives"), F.lit(0)).alias("alternatives"), F.count("*").alias("branched_conversations"))
    roles = nodes.join(observed_messages(t).where(here).select("conversation", "node", F.col("author_role").alias("role")), ["conversation", "node"], "left")
    again = sibling_repeats(roles, group="conversation", parent="parent", role="role").agg(F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("repeats"))), F.lit(0)).alias("regenerated"), F.coalesce(F.sum(F.when(F.col("role") == "user", F.col("repeats"))), F.lit(0)).alias("edited"))
    total = t["conversation_observations"].where(here).agg(F.count("*").alias("conversations"))
    return total.join(forks).join(again).withColumn("branch_rate", ratio(F.col("branched_conversations"), F.col("conversations")))


def entity_deltas(t: Archive) -> DataFrame:
    """entity, snapshot, added, changed, absent for conversations, nodes and messages."""
    out = None
    for entity, table, keys in (("conversation", "conversation_observations", ["conversation"]), ("node", "node_observations", ["conversation", "node"]), ("message", "message_observations", ["conversation", "message"])):
        rows = t[table].select("snapshot", F.concat_ws("\n", *keys).alias("identity"), F.col("raw_sha256").alias("version"))
        one = snapshot_deltas(rows, t["snapshots"]).withColumn("entity", F.lit(entity))
        out = one if out is None else out.unionByName(one)
    return out


def asset_deltas(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snapshot, added, changed, absent of assets by hash against the snapshot before; content-addressed ones never change."""
    order = snapshots.select("snapshot", F.lag("snapshot").over(Window.orderBy("captured_at", "snapshot")).alias("previous")).where("previous IS NOT NULL")
    now = observations.select("snapshot", "sha256").distinct()
    had = order.join(now.withColumnRenamed("snapshot", "previous"), "previous").select("snapshot", "sha256")
    have = order.select("snapshot").join(now, "snapshot")
    count = lambda rows, name: rows.groupBy("snapshot").agg(F.count("*").alias(name))
    added, absent = count(have.join(had, ["snapshot", "sha256"], "left_anti"), "added"), count(had.join(have, ["snapshot", "sha256"], "left_anti"), "absent")
    zero = F.lit(0).cast("long")
    return order.select("snapshot").join(added, "snapshot", "left").join(absent, "snapshot", "left").select("snapshot", F.coalesce("added", zero).alias("added"), zero.alias("changed"), F.coalesce("absent", zero).alias("absent"))


def attachment_analytics(refs: DataFrame) -> DataFrame:
    """snapshot, total, resolved, unresolved, ambiguous and resolved_bytes (each file once)."""
    states = refs.groupBy("snapshot").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "unresolved", "ambiguous")])
    size = refs.where("status = 'resolved'").dropDuplicates(["snapshot", "sha256"]).groupBy("snapshot").agg(F.sum("size").alias("resolved_bytes"))
    return states.join(size, "snapshot", "left").withColumn("resolved_bytes", F.coalesce("resolved_bytes", F.lit(0).cast("long")))


def file_coverage(files: DataFrame, records: DataFrame, assets: DataFrame) -> DataFrame:
    """path, size, media_class, handling, source_record_count, asset_count: what was done with each file of a manifest.

    JSON is decoded if it has records, .dat files are verified by their content's hash, the rest is kept as it is."""
    found = records.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("source_record_count"))
    held = assets.groupBy("path").agg(F.count("*").alias("asset_count"))
    out = files.join(found, "path", "left").join(held, "path", "left").withColumn("media_class", media_class(F.col("path")))
    handling = F.when((F.col("media_class") == "json") & (F.col("source_record_count") > 0), "decoded").when((F.col("media_class") == "dat") & (F.col("asset_count") == 1), "cas_verified").when(F.col("media_class").isin("html", "other"), "preserved_opaque").otherwise("incomplete")
    zero = F.lit(0).cast("long")
    return out.select("path", "size", "media_class", handling.alias("handling"), F.coalesce("source_record_count", zero).alias("source_record_count"), F.coalesce("asset_count", zero).alias("asset_count"))


def completeness_claims(manifest: DataFrame, coverage: DataFrame) -> DataFrame:
    """claim, status: source_complete, extraction_complete (pass or fail), reconciliation_complete (partial) and
    account_complete (not_applicable, as snapshots can't show it)."""
    want = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    have = coverage.agg(F.count("*").alias("n2"), F.coalesce(F.sum("size"), F.lit(0)).alias("b2"), F.count_if(F.col("handling") == "incomplete").alias("bad"))
    closed = (F.col("n") == F.col("n2")) & (F.col("b") == F.col("b2"))
    state = lambda ok: F.when(ok, "pass").otherwise("fail")
    return want.join(have).select(F.explode(F.create_map(F.lit("source_complete"), state(closed), F.lit("extraction_complete"), state(closed & (F.col("bad") == 0)), F.lit("reconciliation_complete"), F.lit("partial"), F.lit("account_complete"), F.lit("not_applicable"))).alias("claim", "status"))


def resolve_sources(refs: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """refs (kind, target, thread) with status and identity: threads by native id, messages by native id within their thread
    if it is known, else anywhere; one hit resolves, none doesn't, several are ambiguous."""
    keyed = refs.withColumn("__n", F.to_json(F.struct("kind", "target", "thread")))
    distinct = keyed.select("__n", "kind", "target", "thread").distinct()
    is_thread = F.col("kind").isin("origination_thread_id", "initiating_conversation_id")
    a = distinct.where(is_thread).join(conversations.select(F.col("native_id").alias("target"), "identity"), "target").select("__n", "identity")
    m = messages.select(F.col("native_id").alias("target"), F.col("thread_native_id").alias("own"), "identity")
    b = distinct.where(~is_thread).join(m, "target").where(F.col("thread").isNull() | (F.col("thread") == F.col("own"))).select("__n", "identity")
    found = a.unionByName(b).groupBy("__n").agg(F.count("*").alias("hits"), F.min("identity").alias("identity"))
    out = keyed.join(found, "__n", "left")
    status = F.when(F.col("hits").isNull(), "unresolved").when(F.col("hits") > 1, "ambiguous").otherwise("resolved")
    return out.withColumn("status", status).withColumn("identity", F.when(F.col("hits") == 1, F.col("identity"))).drop("__n", "hits")
