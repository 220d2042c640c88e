"""Reachability in digraphs and tagged graphs, against plain walks."""

import json
import random

from threadloom.operators.object_graph import external_parts, graph_parts, reachable_from, tagged_graph_faults, tagged_graphs


def walk(edges, roots):
    depth, at, d = {r: 0 for r in roots}, set(roots), 0
    while at:
        d += 1
        at = {t for s, t in edges if s in at and t not in depth}
        depth |= dict.fromkeys(at, d)
    return depth


def test_cycles_and_shared_nodes(spark):
    rnd = random.Random(3)
    edges, roots, want = [], [], {}
    for g in range(12):
        own = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(rnd.randrange(60))]
        first = [rnd.randrange(30) for _ in range(rnd.randrange(3))]
        edges += [(g, s, t) for s, t in own] * 2
        roots += [(g, r) for r in first] * 2
        want |= {(g, n): d for n, d in walk(own, first).items()}
    edges += [(50, i, i + 1) for i in range(40)] + [(50, 40, 7), (None, 1, 2), (50, None, 3), (50, 3, None)]
    roots += [(50, 0), (None, 1), (50, None)]
    want |= {(50, i): i for i in range(41)} | {(None, 1): 0, (None, 2): 1}
    got = reachable_from(spark.createDataFrame(edges, "graph int, source int, target int"), spark.createDataFrame(roots, "graph int, node int"))
    rows = got.collect()
    assert {(r.graph, r.node): r.depth for r in rows} == want and len(rows) == len(want)


def graph(root, nodes, codec="tagged-structured-clone-v1", **more):
    return json.dumps({"codec": codec, "data": {"root": root, "nodes": nodes} | more})


def test_tagged_graphs(spark):
    ref = lambda n: {"$ref": n}
    file = lambda path, n, size, kind="Blob": {"$type": kind, ("byteLength" if kind == "ArrayBuffer" else "size"): size, "data": {"external": {"path": path, "byteLength": n}}}
    rows = {
        "cycle": graph(ref(0), [{"a": ref(1)}, {"b": [ref(0), {"c": ref(1)}]}]),
        "no_nodes": graph("plain", []),
        "lost": graph(ref(0), [{"x": 1}, {"y": ref(2)}, {"z": ref(1)}]),
        "quoted": graph({"say": '"$ref":5 and {"$ref":9}', "at": ref(0)}, [{}]),
        "hidden": '{"codec": "tagged-structured-clone-v1", "data": {"root": {"\\u0024ref": 7}, "nodes": [{}]}}',
        "both": graph({"$ref": 0, "more": 1}, [{}]),
        "part": graph({"$ref": 0.5}, [{}]),
        "negative": graph(ref(-1), [{}]),
        "huge": graph(ref(10**30), [{}]),
        "codec": graph(ref(0), [{}], codec="other"),
        "envelope": json.dumps({"codec": "tagged-structured-clone-v1", "data": {"root": 1, "nodes": []}, "more": 1}),
        "data": graph(1, [], more=2),
        "nodes": graph(1, [3]),
        "null": None,
        "broken": "{",
        "files": graph([ref(0), ref(1), ref(2)], [file("binary/a/1", 3, 3), file("binary/a/2", 5, 5, "ArrayBuffer"), {"data": {"external": 1}}]),
        "wrong_size": graph(ref(0), [file("binary/a/1", 3, 4)]),
        "outside": graph([ref(0), ref(1)], [file("../x", 3, 3), file("a", -1, -1)]),
        "kind": graph(ref(0), [file("a", 1, 1, "Map")]),
    }
    df = spark.createDataFrame(list(rows.items()), "id string, graph string")
    got = {(r.id, r.node, r.fault) for r in tagged_graph_faults(df, key="id", graph="graph").collect()}
    assert got == {
        ("lost", 1, "unreachable"), ("lost", 2, "unreachable"), ("hidden", None, "out_of_range"), ("both", None, "ambiguous_reference"), ("part", None, "ambiguous_reference"),
        ("negative", None, "out_of_range"), ("huge", None, "out_of_range"), ("codec", None, "codec"), ("envelope", None, "envelope"), ("data", None, "data"), ("nodes", None, "nodes"),
        ("null", None, "json"), ("broken", None, "json"), ("wrong_size", 0, "external_size"), ("outside", 0, "external"), ("outside", 1, "external"), ("kind", 0, "external"),
    }
    files = external_parts(graph_parts(tagged_graphs(df.where("id = 'files'"), key="id", graph="graph"))).orderBy("node").collect()
    assert [(r.node, r.kind, r.byte_length, r.path, r.fault) for r in files] == [(0, "Blob", 3, "binary/a/1", None), (1, "ArrayBuffer", 5, "binary/a/2", None)]
    assert tagged_graph_faults(df.limit(0), key="id", graph="graph").collect() == []
