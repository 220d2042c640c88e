import hashlib
import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import canonical, text
from threadloom.operators import graph, snapshots, validation
from threadloom.sources import evidence, exports, logs, sinks


def conversation(cid, answer="first answer", extra=True):
    def node(i, parent, children, role=None, body=None):
        message = {"id": i, "author": {"role": role}, "create_time": 1700000000.5, "content": {"content_type": "text", "parts": [body, {"text": "more"}]}} if role else None
        return {"id": i, "parent": parent, "children": children, "message": message}

    mapping = {"root": node("root", None, ["u"]), "u": node("u", "root", ["a", "b"], "user", "a question"), "a": node("a", "u", [], "assistant", answer), "b": node("b", "u", [], "assistant", "other answer")}
    return {"id": cid, "title": "Title " + cid, "create_time": 1700000000, "current_node": "a", "mapping": mapping} | ({"new_field": 1.0} if extra else {})


@pytest.fixture
def shards(tmp_path):
    for name, content in {"one": [conversation("c1"), conversation("c2")], "two": [conversation("c1", "second answer"), conversation("c2")]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "conversations.json").write_text(json.dumps(content))
    return {name: str(tmp_path / name / "conversations.json") for name in ("one", "two")}


def test_import_reuses_versions_and_is_sound(spark, shards):
    t = exports.import_snapshots(spark, shards, scope="chat/me")
    counts = {k: v.count() for k, v in t.items()}
    assert counts["conversation_observations"] == 4 and counts["conversation_versions"] == 3
    assert counts["message_observations"] == 12 and counts["message_versions"] == 7
    assert counts["node_observations"] == 16 and counts["node_versions"] == 8
    branch = {(r["snapshot"], r["node"]): r["depth"] for r in t["current_branch"].where("conversation LIKE '%c1'").collect()}
    assert branch == {(s, n): d for s in ("one", "two") for d, n in enumerate(["root", "u", "a"])}
    assert {r["check"]: r["violations"] for r in validation.archive_violations(t).where("violations > 0").collect()} == {}
    first = t["message_versions"].where("message = 'u'").collect()[0]
    assert first["text"] == "a question\nmore" and first["author_role"] == "user"


def test_tampering_is_found(spark, shards):
    t = exports.import_snapshots(spark, {"one": shards["one"]}, scope="chat/me")
    t["node_observations"] = t["node_observations"].withColumn("parent", F.when(F.col("node") == "a", "stranger").otherwise(F.col("parent")))
    found = {r["check"] for r in validation.archive_violations(t).where("violations > 0").collect()}
    assert found == {"current_branch_parent_order", "dag_reachability"}


def test_shards_and_broken_files(spark, tmp_path):
    assert sorted(["x/conversations-010.json", "x/conversations-002.json", "x/conversations.json"], key=exports.shard_order) == ["x/conversations.json", "x/conversations-002.json", "x/conversations-010.json"]
    (tmp_path / "conversations.json").write_text('{"a": 1}')
    rows = exports.read_array_elements(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and "array" in rows[0]["error"]


def test_assets_resolve(spark):
    files = spark.createDataFrame([("d/file-1.dat",), ("e/pic.png",), ("f/pic.png",)], "path string")
    refs = spark.createDataFrame([("sediment://file-1#x",), ("pic.png",), ("none",)], "ref string")
    got = {r["ref"]: (r["status"], r["candidate_count"]) for r in exports.resolve_assets(refs, files, reference="ref", path="path").collect()}
    assert got == {"sediment://file-1#x": ("resolved", 1), "pic.png": ("ambiguous", 2), "none": ("unresolved", 0)}


def test_group_chats(spark, tmp_path):
    (tmp_path / "group_chats.json").write_text(json.dumps({"chats": [{"id": "g", "name": "G", "messages": [{"id": "m1", "role": "user", "text": "hi", "created_at": "2024-01-01"}]}]}))
    t = exports.group_chats(spark, str(tmp_path / "group_chats.json"), scope="s", snapshot="one")
    assert t["group_threads"].count() == 1 and t["group_messages"].collect()[0]["message"] == "m1"


def test_evidence_round_trip(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested/a.json").write_text("[1]")
    (tmp_path / "b.dat").write_bytes(b"\0\1")
    entries = evidence.scan_files(spark, str(tmp_path))
    assert {(r["path"], r["size"], r["sha256"]) for r in entries.collect()} == {("nested/a.json", 3, hashlib.sha256(b"[1]").hexdigest()), ("b.dat", 2, hashlib.sha256(b"\0\1").hexdigest())}
    manifest = evidence.build_manifest(entries, source_id="s", source_kind="export", captured_at="2024-01-01", precision="day")
    assert evidence.load_manifest(json.dumps(manifest)) == manifest
    assert evidence.verify_manifest(spark, manifest, str(tmp_path)).count() == 0
    (tmp_path / "b.dat").write_bytes(b"\0\2")
    (tmp_path / "c").write_text("new")
    assert {(r["path"], r["state"]) for r in evidence.verify_manifest(spark, manifest, str(tmp_path)).collect()} == {("b.dat", "changed"), ("c", "unexpected")}
    with pytest.raises(ValueError):
        evidence.load_manifest('{"a": 1, "a": 2}')
    rows = [{"path": "b", "kind": "file"}, {"path": "a", "kind": "file"}]
    assert evidence.tree_sha256(rows) == evidence.tree_sha256(rows[::-1])


def test_logs(spark, tmp_path):
    lines = [{"type": "session", "id": "s"}, {"type": "message", "id": "a", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}]}}, {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "content": "hi"}}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"type": "mess')
    rows = {r["id"]: r for r in logs.session_entries(spark, str(tmp_path / "log.jsonl")).collect()}
    assert rows["a"]["text"] == "hello" and rows["b"]["text"] == "hi" and rows["b"]["parent"] == "a" and len(rows) == 3
    event = {f: None for f in logs.EVENT_FIELDS} | {"event_id": "e1", "kind": "message", "provider": "p", "payload": {"x": 1}}
    (tmp_path / "events.jsonl").write_text("\n".join([json.dumps(event), json.dumps(event), json.dumps(event | {"event_id": "e2"}), json.dumps(event | {"event_id": "e3", "odd": 1}), "[]", json.dumps(event | {"event_id": "e4", "kind": "x"})]))
    events = logs.interchange_events(spark, str(tmp_path / "events.jsonl"))
    assert sorted(str(r["problem"]) for r in events.collect()) == ["None", "duplicate_id", "duplicate_id", "not_an_object", "unknown_field", "unknown_kind"]
    assert logs.event_counts(events).collect()[0]["n"] == 1


def test_canonical_json_keeps_numbers(spark):
    rows = spark.createDataFrame([('{"z": 1.0, "a": "é"}',), ("{",), (None,)], "j string")
    got = [r[0] for r in rows.select(canonical.canonical_json(F.col("j"))).collect()]
    assert got == ['{"a":"é","z":1.0}', None, None]
    assert rows.select(canonical.unknown_fields(F.col("j"), {"z"})).collect()[0][0] == '{"a":"é"}'


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    sinks.insert_parquet(spark, rows, path, ["k"])
    sinks.insert_parquet(spark, rows, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    sinks.upsert_parquet(spark, spark.createDataFrame([(2, "d"), (3, "e")], "k long, v string"), path, path + "2", ["k"])
    assert {r["v"] for r in spark.read.parquet(path + "2").where("k > 1").collect()} == {"d", "e"}
    messages = spark.createDataFrame([("c", 1, "user", "<b>"), ("c", 2, "assistant", "ok")], "thread string, turn int, role string, text string")
    page = sinks.render_conversations(messages, thread="thread", order="turn").collect()[0]["html"]
    assert "&lt;b&gt;" in page and page.index("&lt;b&gt;") < page.index("ok")
    assert "| k |" in sinks.markdown_table(rows.select("k"), "T")


def test_graph_faults_and_cycles(spark):
    nodes = spark.createDataFrame([("g", "r", None), ("g", "x", "r"), ("g", "p", "q"), ("g", "q", "p"), ("h", "r", None), ("h", "y", "lost")], "g string, n string, p string")
    tips = spark.createDataFrame([("g", "r"), ("h", "none")], "g string, t string")
    got = {(r["g"], r["fault"]): r["n"] for r in graph.graph_faults(nodes, tips, group="g", node="n", parent="p", tip="t").collect()}
    assert got == {("g", "unreachable"): 2, ("g", "tip_not_leaf"): 1, ("h", "unresolved_parent"): 1, ("h", "unreachable"): 1, ("h", "unresolved_tip"): 1}
    bad = graph.current_branches(nodes, spark.createDataFrame([("g", "p"), ("h", "y")], "g string, t string"), group="g", node="n", parent="p", tip="t")
    assert bad.count() == 0


@pytest.mark.parametrize("order", [["s1", "s2", "s3", "s4"], ["s3", "s1", "s4", "s2"]])
def test_absence_lasts_until_the_identity_is_back(spark, order):
    captures = spark.createDataFrame([(s, s) for s in order], "snapshot string, captured_at string")
    seen = spark.createDataFrame([("s1", "x"), ("s4", "x"), ("s2", "y"), ("s1", "z"), ("s2", "z"), ("s3", "z"), ("s4", "z")], "snapshot string, identity string")
    got = {(r["snapshot"], r["identity"], r["prior_snapshot"]) for r in snapshots.source_absences(seen, captures).collect()}
    assert got == {("s2", "x", "s1"), ("s3", "x", "s1"), ("s3", "y", "s2"), ("s4", "y", "s2")}


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).collect()[0][0]
    lit = F.lit
    assert value(text.media_class(lit("a/B.JSON"))) == "json" and value(text.media_class(lit("noext"))) == "other"
    assert value(text.json_pointer_component(lit("a/b~c"))) == "a~1b~0c"
    assert value(text.normal_asset_reference(lit("https://h/x/y.png?z#q"))) == "y.png"
    assert value(text.safe_component(lit("../a b/c"))) == "a-b-c"
    assert value(text.display_time(lit(0.0))) == "unknown"
    assert value(text.collapse_space(lit(" a　 b\n"))) == "a b"
    assert value(text.validity(lit("2024-01-01"), lit("2024-06-01"), "2024-03-01", lit(False))) == "within_user_stated_period"
    assert value(text.validity(lit(None).cast("string"), lit("2024-06-01"), "2024-07-01", lit(False))) == "expired"
    assert value(text.like_literal(lit("100%"), "0%")) and not value(text.like_literal(lit("100x"), "0%"))


def test_publish_never_replaces(tmp_path):
    import hashlib

    from threadloom.sources import packs

    sha = hashlib.sha256(b"one").hexdigest()
    for _ in range(2):
        (tmp_path / "staging-a").write_bytes(b"one")
        packs.publish(str(tmp_path / "staging-a"), str(tmp_path / "out" / "x"), sha)
    (tmp_path / "staging-a").write_bytes(b"two")
    with pytest.raises(ValueError):
        packs.publish(str(tmp_path / "staging-a"), str(tmp_path / "out" / "x"), hashlib.sha256(b"two").hexdigest())
    assert (tmp_path / "out" / "x").read_bytes() == b"one" and packs.staging_residue(str(tmp_path)) == ["staging-a"]


def test_registries_and_records(spark, tmp_path):
    from pyspark.sql import functions as F

    from threadloom.functions import text
    from threadloom.sources import exports

    (tmp_path / "names.json").write_text('{"a.dat": "A", "b": "B"}')
    assert {(r["asset"], r["name"]) for r in exports.friendly_names(spark, str(tmp_path / "names.json")).collect()} == {("a.dat", "A"), ("a", "A"), ("b", "B"), ("b.dat", "B")}
    (tmp_path / "library_files.json").write_text('[{"file_id": "f1"}, {"file_id": "f1"}, {"file_id": 3}]')
    files = exports.library_files(spark, str(tmp_path / "library_files.json"))
    assert sorted(str(r["native_id"]) for r in files.collect()) == ["None", "f1", "f1"] and [r["n"] for r in exports.repeated_ids(files).collect()] == [2]
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01",), ("2024-01-01 00:00:00.5",), ("x",)], "t string")
    day = 1_704_067_200_000_000
    assert [r[0] for r in times.select(text.captured_micros(F.col("t"))).collect()] == [day, day, day, day + 500_000, None]
    rows = spark.createDataFrame([('{"conversation_id": "c", "id": 3}', "conversation"), ('{"id": "m", "message_id": "n"}', "message_feedback"), ("[1]", "user")], "raw string, kind string")
    assert [r[0] for r in rows.select(text.native_id(F.col("kind"), F.col("raw"))).collect()] == ["c", "m", None]
    raws = ['{"content":{"text":"a","parts":["","b",{"text":"c"},{"text":1},2]}}', '{"content":{"parts":"abc"}}', '{"content":"x"}', "{}"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(text.message_text(F.col("raw"))).collect()]
    import json

    assert got == [exports.message_text(json.loads(r)) for r in raws] == ["a\n\nb\nc", "", "", ""]
    refs = spark.createDataFrame([(" https://h/files/a.png/ ",), ("file-service://x#y",), ("a/b.dat?z#q",), ("///",), ("",)], "r string")
    assert [r[0] for r in refs.select(text.normal_asset_reference(F.col("r"))).collect()] == ["a.png", "x", "b.dat", None, None]


def test_tree_digest_has_fields_in_the_formats_order():
    import hashlib

    from threadloom.sources import evidence

    entries = [{"path": "b", "kind": "directory"}, {"path": "a", "kind": "file", "size": 1, "sha256": "00"}]
    assert evidence.tree_sha256(entries) == hashlib.sha256(b"file\0a\x001\x0000\0\0directory\0b\0\0\0\0").hexdigest()


def test_deep_trees_cycles_and_strangers(spark):
    from threadloom.operators import graph

    rows = [(1, i, i - 1 if i else None) for i in range(300)] + [(1, 1000, 1001), (1, 1001, 1000), (1, 1002, 1000), (1, 1003, 5000), (1, 1004, 1003), (2, 7, None)]
    got = {(r["g"], r["n"]): r["depth"] for r in graph.reachable(spark.createDataFrame(rows, "g int, n int, p int"), group="g", node="n", parent="p").collect()}
    assert got == {(1, i): i for i in range(300)} | {(2, 7): 0}


def test_ordinal_faults(spark):
    from threadloom.operators import validation

    good = "a" * 64
    rows = spark.createDataFrame([("s", 0, good), ("s", 1, "x"), ("s", 3, good), ("t", 0, good)], "store string, ordinal int, digest string")
    assert sorted((r["store"], r["ordinal"], r["fault"]) for r in validation.ordinal_faults(rows, group="store", order="ordinal", digest="digest").collect()) == [("s", 1, "digest"), ("s", 3, "ordinal")]


def test_fingerprints_don_t_depend_on_the_origin():
    from threadloom.sources import evidence

    entries = lambda origin: [{"kind": "file", "path": f"{origin}.indexeddb.leveldb/{n}", "size": 1, "sha256": "00"} for n in ("b", "a")]
    assert evidence.payload_fingerprint(entries("x"), "x") == evidence.payload_fingerprint(entries("yy")[::-1], "yy")
    with pytest.raises(ValueError):
        evidence.payload_fingerprint(entries("x"), "y")


def test_only_an_unfinished_last_line_is_left(spark, tmp_path):
    from threadloom.sources import logs

    line = '{"type":"message","id":"%s","message":{"role":"user","content":"x"}}'
    (tmp_path / "a.jsonl").write_text(line % "a" + "\n" + line % "b" + '\n{"type":')
    assert sorted(r["id"] for r in logs.session_entries(spark, str(tmp_path / "a.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "b.jsonl").write_text(line % "a" + '\n{"type":\n' + line % "b" + "\n")
    with pytest.raises(ValueError):
        logs.session_entries(spark, str(tmp_path / "b.jsonl"))


def test_command_line(spark, tmp_path, capsys):
    import os

    from threadloom.__main__ import main

    assert main(["list"]) == 0 and "keyword_hits" in capsys.readouterr().out
    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        assert main(["run", "role_distribution", folder, "--out", str(tmp_path / "out")]) == 0
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_broken_files_stop_the_queries(spark, tmp_path):
    (tmp_path / "conversations.json").write_text('[{"id": "a", "mapping": {}}, {"id": ')
    (tmp_path / "library_files.json").write_text('{"file_id": "f1"}')
    with pytest.raises(Exception, match="broken source"):
        exports.import_snapshots(spark, {"one": str(tmp_path / "conversations.json")}, scope="s")
    with pytest.raises(Exception, match="broken source"):
        exports.library_files(spark, str(tmp_path / "library_files.json")).collect()
    for i, text in enumerate(['{"chats": [{"id": "g", "messages"', "[]", '{"chats": [{"id": "g"}]}', '{"chats": [{"id": "g", "messages": [{"text": "x"}]}]}']):
        (tmp_path / f"group{i}.json").write_text(text)
        with pytest.raises(Exception, match="broken group chats"):
            exports.group_chats(spark, str(tmp_path / f"group{i}.json"), scope="s", snapshot="one")["group_messages"].collect()


def test_repeated_keys_are_json_and_the_last_counts(spark):
    from threadloom.functions.canonical import last_keys
    from threadloom.functions.text import message_text

    rows = [('{"content":{"text":"x","text":"y"}}',), ('{"a":1,"a":2}',), ("[1, {\"b\":1,\"b\":[2]}]",), ("{",), ("NaN",), ('{"a":NaN,"a":1}',), (None,), ("3",)]
    df = spark.createDataFrame(rows, "j string")
    assert [r[0] for r in df.select(last_keys(F.col("j"))).collect()] == ['{"content":{"text":"y"}}', '{"a":2}', '[1,{"b":[2]}]', None, None, None, None, "3"]
    assert [(r["column"], r["n"]) for r in validation.invalid_json(df, ["j"]).collect()] == [("j", 3)]
    assert [r[0] for r in df.select(message_text(F.col("j"))).collect()][:2] == ["y", ""]
