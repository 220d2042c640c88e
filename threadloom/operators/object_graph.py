"""Object graphs: digraphs in which nodes are shared and may be in cycles, and the tagged JSON form that recovered rows have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import _cut

#: The codec that a tagged graph names, and the kinds of nodes whose bytes lie in a file of their own.
CODEC = "tagged-structured-clone-v1"
BINARY_KINDS = ("ArrayBuffer", "Blob", "File")
MAX_SAFE = 2**53 - 1


def reachable_from(edges: DataFrame, roots: DataFrame, *, group: str = "graph", source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """group, node, depth of every node that a root reaches along edges: depth is the least number of edges, 0 for roots.

    The frontier goes forward by one edge a round: it is joined with the edges, its new nodes are those that no round before had,
    and these alone are written and go on. A node with many in-edges is one row after the map-side distinct; one with many
    out-edges is a large key of a plain join, which adaptive execution splits. There are as many rounds as the farthest node is
    deep. Null groups are a group of their own; null nodes are nowhere; repeated edges and roots count once."""
    steps = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(group).alias("g"), F.col(source).alias("s"), F.col(target).alias("n")).distinct()
    steps = _cut(steps)
    frontier = _cut(roots.where(F.col(node).isNotNull()).select(F.col(group).alias("g"), F.col(node).alias("n")).distinct())
    seen, depth = frontier.withColumn("d", F.lit(0).cast("long")), 0
    while not frontier.isEmpty():
        depth += 1
        here = frontier.select(F.col("g").alias("g0"), F.col("n").alias("s0"))
        ahead = here.join(steps, F.col("g0").eqNullSafe(F.col("g")) & (F.col("s0") == F.col("s"))).select("g", "n").distinct()
        known = seen.select(F.col("g").alias("g0"), F.col("n").alias("n0"))
        frontier = _cut(ahead.join(known, F.col("g").eqNullSafe(F.col("g0")) & (F.col("n") == F.col("n0")), "left_anti"))
        seen = seen.unionByName(frontier.withColumn("d", F.lit(depth).cast("long")))
        if depth % 16 == 0:  # plans of many rounds don't nest
            seen = _cut(seen)
    return seen.select(F.col("g").alias(group), F.col("n").alias(node), F.col("d").alias("depth"))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def tagged_graphs(rows: DataFrame, *, key: str, graph: str) -> DataFrame:
    """key, fault, n_nodes and the parts of each row's graph as JSON texts: root, and nodes in their order.

    fault: json, envelope (other fields than codec and data), codec, data (other fields than root and nodes) or nodes (no array
    of objects); null where the form is right. Null graphs are json faults. Field names and strings are written anew, so that
    escapes hide nothing."""
    v = F.try_parse_json(graph)
    keys = lambda path: F.array_sort(F.coalesce(F.json_object_keys(F.to_json(_get(v, path, "variant"))), F.array().cast("array<string>")))
    is_ = lambda path, kind: F.startswith(F.coalesce(F.schema_of_variant(_get(v, path, "variant")), F.lit("")), F.lit(kind))
    nodes = _get(v, "$.data.nodes", "array<variant>")
    texts = F.transform(nodes, lambda x: F.to_json(x))
    objects = F.forall(nodes, lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False)))
    wanted = lambda *names: F.array(*map(F.lit, names))
    fault = (
        F.when(v.isNull(), "json")
        .when(~is_("$", "OBJECT") | (keys("$") != wanted("codec", "data")), "envelope")
        .when(~F.coalesce(_get(v, "$.codec", "string") == CODEC, F.lit(False)), "codec")
        .when(~is_("$.data", "OBJECT") | (keys("$.data") != wanted("nodes", "root")), "data")
        .when(~is_("$.data.nodes", "ARRAY") | ~F.coalesce(objects, F.lit(False)), "nodes")
    )
    return rows.select(F.col(key).alias("key"), fault.alias("fault"), F.size(nodes).alias("n_nodes"), F.to_json(_get(v, "$.data.root", "variant")).alias("root"), texts.alias("nodes"))


#: Keys of references in JSON text that variants have written, and references as they must be.
REFERENCE_KEY, REFERENCE = r'(?<!\\)"\$ref":', r'\{"\$ref":(-?\d+)\}'


def graph_parts(graphs: DataFrame) -> DataFrame:
    """key, node (null: the root), part (JSON text), n_nodes of the graphs that have the right form."""
    whole = graphs.where("fault IS NULL")
    nodes = whole.select("key", "n_nodes", F.posexplode("nodes").alias("node", "part"))
    return whole.select("key", F.lit(None).cast("int").alias("node"), F.col("root").alias("part"), "n_nodes").unionByName(nodes.select("key", "node", "part", "n_nodes"))


def tagged_graph_faults(rows: DataFrame, *, key: str, graph: str) -> DataFrame:
    """key, node, fault of rows' tagged graphs: the faults of form (node null); ambiguous_reference (a $ref beside other fields,
    or one that is no integer); out_of_range; unreachable (no way from the root); external (bytes that a node names without a
    path, length or kind as they must be, or outside the folder); external_size (the node's own size differs).

    Keys must be unique; references are edges, and the root's edges lead to the roots of the search. Only graphs of the right
    form, all of whose references are good, are searched."""
    graphs = _cut(tagged_graphs(rows, key=key, graph=graph))
    parts = _cut(graph_parts(graphs))
    form = graphs.where("fault IS NOT NULL").select("key", F.lit(None).cast("int").alias("node"), "fault")
    to = F.transform(F.regexp_extract_all("part", F.lit(REFERENCE), F.lit(1)), lambda x: x.try_cast("int"))
    bad = F.exists(to, lambda x: x.isNull() | (x < 0) | (x >= F.col("n_nodes")))
    reference = F.when(F.regexp_count("part", F.lit(REFERENCE_KEY)) != F.regexp_count("part", F.lit(REFERENCE)), "ambiguous_reference").when(bad, "out_of_range")
    wrong = parts.select("key", "node", reference.alias("fault")).where("fault IS NOT NULL")
    sound = parts.join(wrong.select("key").distinct(), "key", "left_anti")
    edges = sound.select("key", F.col("node").alias("source"), F.explode(F.array_distinct(to)).alias("target"))
    roots = edges.where("source IS NULL").select("key", F.col("target").alias("node"))
    found = reachable_from(edges, roots, group="key").select("key", "node")
    lost = sound.where("node IS NOT NULL").select("key", "node").join(found, ["key", "node"], "left_anti").withColumn("fault", F.lit("unreachable"))
    files = external_parts(parts)
    outside = files.where("fault IS NOT NULL").select("key", "node", "fault")
    return form.unionByName(wrong).unionByName(lost).unionByName(outside).withColumnRenamed("key", key)


def external_parts(parts: DataFrame) -> DataFrame:
    """key, node, kind, byte_length, path, fault of the nodes whose data is {"external": {"path", "byteLength"}}."""
    v = F.parse_json("part")
    names = lambda path: F.array_sort(F.json_object_keys(F.to_json(_get(v, path, "variant"))))
    external = parts.where("node IS NOT NULL").where(names("$.data") == F.array(F.lit("external"))).where(F.startswith(F.schema_of_variant(_get(v, "$.data.external", "variant")), F.lit("OBJECT")))
    whole = lambda path: F.when(F.schema_of_variant(_get(v, path, "variant")) == "BIGINT", _get(v, path, "bigint"))
    kind, path, length = _get(v, "$['$type']", "string"), _get(v, "$.data.external.path", "string"), whole("$.data.external.byteLength")
    own = F.when(kind == "ArrayBuffer", whole("$.byteLength")).otherwise(whole("$.size"))
    text = F.schema_of_variant(_get(v, "$.data.external.path", "variant")) == "STRING"
    safe = text & (path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    formed = (names("$.data.external") == F.array(F.lit("byteLength"), F.lit("path"))) & kind.isin(*BINARY_KINDS) & safe & length.between(0, MAX_SAFE)
    fault = F.when(~F.coalesce(formed, F.lit(False)), "external").when(~own.eqNullSafe(length), "external_size")
    return external.select("key", "node", kind.alias("kind"), length.alias("byte_length"), path.alias("path"), fault.alias("fault"))
