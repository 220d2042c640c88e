import json
import zipfile

import pytest
from pyspark.sql import functions as F
from test_sources import conversation

from threadloom.functions import references
from threadloom.operators import archive, evaluation
from threadloom.sources import exports, packs


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    paths = {}
    for name, content in {"one": [conversation("c1"), conversation("c3")], "two": [conversation("c1", "second answer 检索词"), conversation("c2")]}.items():
        (folder / name).mkdir()
        (folder / name / "conversations.json").write_text(json.dumps(content))
        paths[name] = str(folder / name / "conversations.json")
    out = exports.import_snapshots(spark, paths, scope="s")
    out = {k: v.cache() for k, v in out.items()}
    return out | {"snapshots": spark.createDataFrame([("one", "2024-01-01"), ("two", "2024-02-01")], "snapshot string, captured_at string")}


def test_library_keeps_what_later_snapshots_lack(t):
    rows = {r["conversation"][-2:]: r["snapshot"] for r in archive.library(t).collect()}
    assert rows == {"c1": "two", "c2": "two", "c3": "one"}
    assert [r["conversation"][-2:] for r in archive.library(t, "检索词").collect()] == ["c1"]
    assert [r["conversation"][-2:] for r in archive.library(t, "title C3").collect()] == ["c3"]


def test_lists_and_details(t):
    rows = {r["conversation"][-2:]: r for r in archive.list_conversations(t, "one").collect()}
    assert rows["c3"]["absent_later"] and not rows["c1"]["absent_later"]
    assert (rows["c1"]["nodes"], rows["c1"]["messages"], rows["c1"]["branch_points"], rows["c1"]["alternatives"]) == (4, 3, 1, 1)
    assert rows["c1"]["preview"] == "a question\nmore"
    detail = archive.conversation_detail(t, "one", "s/conversations/c1").collect()
    assert [r["node"] for r in detail] == ["root", "u", "a", "b"] and detail[1]["children"] == ["a", "b"]
    assert archive.recent_messages(t).count() == 6


def test_analytics(t):
    r = archive.branch_analytics(t, "one").collect()[0]
    assert (r["conversations"], r["branch_points"], r["regenerated"], r["edited"], r["branch_rate"]) == (2, 2, 2, 0, 1.0)
    got = {(x["entity"], x["snapshot"]): (x["added"], x["changed"], x["absent"]) for x in archive.entity_deltas(t).collect()}
    assert got["conversation", "two"] == (1, 1, 1) and got["conversation", "one"] == (0, 0, 0)
    assert got["message", "two"] == (3, 1, 3)


def test_assets_coverage_and_claims(spark):
    seen = spark.createDataFrame([("one", "x"), ("one", "y"), ("two", "y"), ("two", "z")], "snapshot string, sha256 string")
    order = spark.createDataFrame([("one", "1"), ("two", "2")], "snapshot string, captured_at string")
    assert [tuple(r) for r in archive.asset_deltas(seen, order).collect()] == [("two", 1, 0, 1)]
    files = spark.createDataFrame([("a.json", 3), ("b.dat", 2), ("c.html", 1)], "path string, size long")
    records, assets = spark.createDataFrame([("a.json",)], "source_file string"), spark.createDataFrame([("b.dat",)], "path string")
    covered = archive.file_coverage(files, records, assets)
    assert {r["path"]: r["handling"] for r in covered.collect()} == {"a.json": "decoded", "b.dat": "cas_verified", "c.html": "preserved_opaque"}
    assert {r["claim"]: r["status"] for r in archive.completeness_claims(files, covered).collect()}["extraction_complete"] == "pass"
    assert {r["claim"]: r["status"] for r in archive.completeness_claims(files, covered.limit(2)).collect()}["source_complete"] == "fail"
    refs = spark.createDataFrame([("one", "resolved", "x", 5), ("one", "resolved", "x", 5), ("one", "ambiguous", None, None)], "snapshot string, status string, sha256 string, size long")
    assert archive.attachment_analytics(refs).collect()[0].asDict() == {"snapshot": "one", "total": 3, "resolved": 2, "unresolved": 0, "ambiguous": 1, "resolved_bytes": 5}


def test_sources_resolve(spark):
    refs = spark.createDataFrame([("origination_thread_id", "t1", None), ("origination_message_id", "m1", "t1"), ("origination_message_id", "m1", None), ("origination_message_id", "m9", None)], "kind string, target string, thread string")
    threads = spark.createDataFrame([("t1", "T1")], "native_id string, identity string")
    messages = spark.createDataFrame([("m1", "t1", "M1"), ("m1", "t2", "M2")], "native_id string, thread_native_id string, identity string")
    got = [(r["status"], r["identity"]) for r in archive.resolve_sources(refs, threads, messages).orderBy("kind", "target", F.desc("thread")).collect()]
    assert sorted(got, key=str) == sorted([("ambiguous", None), ("resolved", "M1"), ("unresolved", None), ("resolved", "T1")], key=str)


def test_asset_references_at_any_depth(spark):
    message = {"content": {"parts": [{"asset_pointer": "p1", "deep": {"audio_asset_pointer": {"asset_pointer": "p2"}}}, {"frames_asset_pointers": ["f1", 2]}], "asset_pointer_links": ["l1"]}, "metadata": {"attachments": [{"id": "i1"}, {"id": "i2", "file_id": "f2"}, 3]}}
    found = [x[:2] for x in references.references_of(message)]
    assert found == [("asset_pointer", "p1"), ("audio_asset_pointer", "p2"), ("frames_asset_pointer", "f1"), ("asset_pointer_link", "l1"), ("attachment_id", "i1"), ("attachment_file_id", "f2")]
    references.register(spark)
    spark.createDataFrame([(1, json.dumps(message)), (2, None)], "id int, payload string").createOrReplaceTempView("threadloom_payloads")
    assert spark.sql("SELECT id, r.ordinal, r.reference FROM threadloom_payloads, LATERAL asset_references(payload) r").count() == 6
    deep = json.loads('{"a":' * 900 + '{"asset_pointer": "x"}' + "}" * 900)
    assert len(references.references_of({"content": deep})) == 1


def test_recall_of_labels(spark):
    cases = spark.createDataFrame([("hit",), ("miss",), ("none",)], "case_id string")
    evidence = spark.createDataFrame([("hit", "m1", "tea"), ("miss", "m2", "tea")], "case_id string, message string, quote string")
    hits = spark.createDataFrame([("hit", "m1"), ("miss", "m9")], "case_id string, message string")
    results = evaluation.source_recall(cases, evidence, hits, ["message"])
    assert {r["case_id"]: r["source_recall"] for r in results.collect()} == {"hit": 1.0, "miss": 0.0, "none": None}
    assert evaluation.summary(results).collect()[0].asDict() == {"cases": 3, "positive_cases": 2, "all_sources_found": 1, "no_record_cases": 1, "empty_no_record_cases": 1}
    messages = spark.createDataFrame([("m1", "user", "I like tea"), ("m2", "user", "coffee")], "message string, role string, text string")
    assert [r["case_id"] for r in evaluation.stale_anchors(evidence, messages, ["message"]).collect()] == ["miss"]


def test_packs(tmp_path):
    for name, entry in (("good", "x/conversations.json"), ("bad", "../conversations.json")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(entry, "[]")
    root = packs.extract_export(str(tmp_path / "good.zip"), str(tmp_path / "in"))
    assert root.endswith("/x") and packs.extract_export(str(tmp_path / "good.zip"), str(tmp_path / "in")) == root
    with pytest.raises(ValueError):
        packs.extract_export(str(tmp_path / "bad.zip"), str(tmp_path / "in2"))
    for day in ("2024-01-02", "2023-12-31"):
        (tmp_path / "exports" / f"export-{day}").mkdir(parents=True)
    assert packs.latest_export(str(tmp_path / "exports")).endswith("2024-01-02")
    files = {"a.md": "x", "profile.md": packs.profile_markdown([{"kind": "plan", "statement": "s", "sources": [1]}])}
    assert packs.write_pack(str(tmp_path / "p1"), files)["tree_sha256"] == packs.write_pack(str(tmp_path / "p2"), dict(reversed(files.items())))["tree_sha256"]
    assert packs.verify_pack(str(tmp_path / "p1")) == []
    (tmp_path / "p1/a.md").write_text("y")
    (tmp_path / "p1/new").write_text("")
    assert packs.verify_pack(str(tmp_path / "p1")) == ["a.md", "new"]
