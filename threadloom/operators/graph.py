"""Operators on conversation graphs: forests of nodes with a parent pointer, one tree set for each group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one for checkpoints, which a cluster's session must name."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that plans of many rounds don't nest."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reachable(edges: DataFrame, *, group: str, node: str, parent: str) -> DataFrame:
    """group, node, depth of all nodes that a root (a node without parent) reaches; nodes of a cycle, below one or below an
    unknown parent aren't among them.

    Pointer doubling: each round replaces a node's pointer by its target's, so that a tree of depth d takes log2(d) rounds
    of one equal join. As a tree has nodes of every depth up to its own, a round that brings none to a root is the last."""
    state = edges.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(parent).alias("p"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("d"))
    state = _cut(state)
    arrived = state.where("p IS NULL").count()
    while True:
        ahead = state.select("g", F.col("n").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"))
        state = _cut(state.where("p IS NULL").unionByName(state.where("p IS NOT NULL").join(ahead, ["g", "p"]).select("g", "n", F.col("p2").alias("p"), (F.col("d") + F.col("d2")).alias("d"))))
        now = state.where("p IS NULL").count()
        if now == arrived:
            break
        arrived = now
    return state.where("p IS NULL").select(F.col("g").alias(group), F.col("n").alias(node), F.col("d").alias("depth"))


def branch_of(parents: Column, tip: Column) -> Column:
    """The nodes from the root to tip as an array, from a map node -> parent; a cycle or a missing parent gives null.

    A walk inside one row: a conversation's graph is one map, and no join is needed for any depth."""
    step = F.struct(tip.alias("at"), F.array(tip).alias("path"), F.lit(False).alias("bad"))
    size = F.size(parents)

    def up(acc, _):
        parent = F.try_element_at(parents, acc["at"])
        stop = acc["at"].isNull() | acc["bad"]
        known = parent.isNull() | F.map_contains_key(parents, parent)
        ahead = F.struct(parent.alias("at"), F.when(parent.isNull(), acc["path"]).otherwise(F.concat(F.array(parent), acc["path"])).alias("path"), (~known | F.array_contains(acc["path"], parent)).alias("bad"))
        return F.when(stop, acc).otherwise(F.struct(ahead["at"].alias("at"), ahead["path"].alias("path"), F.coalesce(ahead["bad"], F.lit(False)).alias("bad")))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), step, up)
    ok = ~walked["bad"] & F.map_contains_key(parents, tip) & walked["at"].isNull()
    return F.when(ok, walked["path"])


def current_branches(nodes: DataFrame, tips: DataFrame, *, group: str, node: str, parent: str, tip: str) -> DataFrame:
    """group, node, depth: each group's path from the root to its tip; depth starts at 0."""
    # map values can't be null in a lookup that must tell roots from strangers: roots are null and their key is there.
    maps = nodes.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(node, parent))).alias("parents"))
    path = maps.join(tips.select(group, tip), group).select(group, branch_of(F.col("parents"), F.col(tip)).alias("path"))
    return path.select(group, F.posexplode("path").alias("depth", node)).select(group, node, F.col("depth").cast("long").alias("depth"))


def branch_points(nodes: DataFrame, *, group: str, parent: str) -> DataFrame:
    """group, branch_points, alternatives: parents with several children, and the children beyond the first."""
    children = nodes.where(F.col(parent).isNotNull()).groupBy(group, parent).agg(F.count("*").alias("n")).where("n > 1")
    return children.groupBy(group).agg(F.count("*").alias("branch_points"), F.sum(F.col("n") - 1).alias("alternatives"))


def sibling_repeats(nodes: DataFrame, *, group: str, parent: str, role: str) -> DataFrame:
    """role, repeats: siblings beyond the first of one role (regenerated answers, edited questions)."""
    same = nodes.where(F.col(parent).isNotNull() & F.col(role).isNotNull()).groupBy(group, parent, role).agg(F.count("*").alias("n")).where("n > 1")
    return same.groupBy(role).agg(F.sum(F.col("n") - 1).alias("repeats"))


def graph_faults(nodes: DataFrame, tips: DataFrame, *, group: str, node: str, parent: str, tip: str) -> DataFrame:
    """group, fault, n: unresolved_parent, unreachable (in a cycle, or below one or below a stranger), unresolved_tip,
    tip_not_leaf and root_count (roots other than one)."""
    known = nodes.select(group, F.col(node).alias(parent))
    strangers = nodes.where(F.col(parent).isNotNull()).join(known, [group, parent], "left_anti").select(group, F.lit("unresolved_parent").alias("fault"))
    lost = nodes.join(reachable(nodes, group=group, node=node, parent=parent).select(group, node), [group, node], "left_anti").select(group, F.lit("unreachable").alias("fault"))
    at = tips.select(group, F.col(tip).alias(node))
    nowhere = at.join(nodes.select(group, node), [group, node], "left_anti").select(group, F.lit("unresolved_tip").alias("fault"))
    inner = at.join(nodes.select(group, F.col(parent).alias(node)), [group, node], "left_semi").select(group, F.lit("tip_not_leaf").alias("fault"))
    roots = nodes.groupBy(group).agg(F.count_if(F.col(parent).isNull()).alias("n")).where("n <> 1").select(group, F.lit("root_count").alias("fault"))
    every = strangers.unionByName(lost).unionByName(nowhere).unionByName(inner).unionByName(roots)
    return every.groupBy(group, "fault").agg(F.count("*").alias("n"))


def session_branches(entries: DataFrame, leaves: DataFrame, *, group: str, node: str, parent: str, leaf: str) -> DataFrame:
    """group, state, length: whether the path from each session's leaf to a root is complete, and how many entries it has;
    broken (length 0) where an entry is missing or the path comes back to one."""
    paths = current_branches(entries, leaves, group=group, node=node, parent=parent, tip=leaf).groupBy(group).agg(F.count("*").alias("length"))
    out = leaves.select(group).distinct().join(paths, group, "left")
    return out.select(group, F.when(F.col("length").isNull(), "broken").otherwise("complete").alias("state"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))
