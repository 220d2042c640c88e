"""Content-addressed copies by tasks, and pages with their index."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators.validation import store_faults
from threadloom.sources import commits, evidence, sinks


def test_assets_are_copied_once_and_whole(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    contents = [b"", b"a", b"b" * 3_000_000, b"a"]
    for i, c in enumerate(contents):
        (source / f"{i}.bin").write_bytes(c)
    sha = lambda c: hashlib.sha256(c).hexdigest()
    rows = [(f"file://{source}/{i}.bin", sha(c)) for i, c in enumerate(contents)]
    files = spark.createDataFrame(rows, "path string, sha256 string")
    got = {(r.sha256, r.size, r.state) for r in sinks.store_assets(files, f"file://{root}").collect()}
    assert got == {(sha(c), len(c), "written") for c in contents}
    # all rows by tasks of their own at the same time, each content twice
    both = files.unionByName(files.withColumn("sha256", F.lower("sha256"))).repartition(8)
    assert {r.state for r in sinks.store_assets(both, f"file://{root}").collect()} == {"present"}
    assets = sinks.store_assets(files, f"file://{root}").select("sha256", "size")
    stored = evidence.scan_files(spark, str(root))
    assert sorted(os.path.relpath(p, root) for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p)) == sorted({sinks.asset_path(sha(c)) for c in contents})
    assert store_faults(assets.where("size > 0"), stored).collect() == []
    wrong = spark.createDataFrame([(f"file://{source}/1.bin", "0" * 64)], "path string, sha256 string")
    with pytest.raises(Exception, match="has other bytes"):
        sinks.store_assets(wrong, f"file://{root}").collect()
    (root / sinks.asset_path(sha(b"a"))).write_bytes(b"A")
    with pytest.raises(Exception, match="has other bytes"):
        sinks.store_assets(files, f"file://{root}").collect()
    assert not glob.glob(f"{root}/**/*.part", recursive=True)


def test_pages_are_held_against_their_index(spark, tmp_path):
    root = str(tmp_path / "pages")
    rows = [("t1", 1, "user", "<b> & 'q' \"d\""), ("t1", 0, "assistant", None), ("t2", 0, 'a"b', "x\ny"), ("t3", 0, None, "z"), ("t4", 5, "user", "w")]
    messages = spark.createDataFrame(rows, "thread string, n int, role string, text string")
    pages = {r.thread: r.html for r in sinks.render_conversations(messages, thread="thread", order="n").collect()}
    for t in pages:
        assert pages[t] == sinks.render_conversation(t, [{"role": r, "text": x} for th, _, r, x in sorted(rows, key=lambda r: r[1]) if th == t])
    assert sinks.write_pages(spark, root, "one", messages, thread="thread", order="n") == "committed"
    assert sinks.write_pages(spark, root, "one", messages, thread="thread", order="n") == "no_op"
    assert sinks.page_faults(spark, root).collect() == []
    attempt = commits.commits(spark, root).first()["attempt"]
    changed = [("t1", pages["t1"]), ("t2", pages["t2"] + " "), ("t4", pages["t4"]), ("t4", pages["t4"]), ("t9", "new")]
    spark.createDataFrame(changed, "thread string, html string").write.mode("overwrite").parquet(f"{root}/data/pages/attempt={attempt}")
    assert {(r.thread, r.fault) for r in sinks.page_faults(spark, root).collect()} == {("t2", "altered"), ("t3", "missing"), ("t4", "repeated"), ("t9", "unexpected")}
