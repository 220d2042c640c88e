"""Imports that become visible together, and growing logs."""

import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import commits, framed, tailing
from threadloom.streaming import sessions


def test_nothing_is_visible_before_all_tables_are(spark, tmp_path):
    root = str(tmp_path / "archive")
    a = spark.createDataFrame([(1, "x", None), (2, None, ["p"]), (2, None, ["p"])], "id int, t string, l array<string>")
    b = spark.createDataFrame([], "n long")
    broken = a.select(F.when(F.col("id") == 2, F.raise_error(F.lit("crash")).cast("string")).otherwise("t").alias("t"))
    with pytest.raises(Exception, match="crash"):
        commits.publish(spark, root, "one", {"a": a, "b": broken})
    assert glob.glob(f"{root}/data/a/*") and commits.commits(spark, root).count() == 0
    with pytest.raises(ValueError):
        commits.committed(spark, root, "a")
    assert commits.publish(spark, root, "one", {"a": a, "b": b}, profile={"v": 1}) == "committed"
    assert commits.publish(spark, root, "two", {"a": a.limit(1)}, profile={"v": 1}) == "committed"
    before = sorted(glob.glob(f"{root}/**", recursive=True))
    assert commits.publish(spark, root, "one", {"b": b, "a": a.repartition(3)}, profile={"v": 1}) == "no_op"
    assert sorted(glob.glob(f"{root}/**", recursive=True)) == before
    rows = commits.committed(spark, root, "a").groupBy("snapshot_key").count().collect()
    assert {tuple(r) for r in rows} == {("one", 3), ("two", 1)} and commits.committed(spark, root, "b").count() == 0
    for other, profile in (({"a": a.limit(2), "b": b}, {"v": 1}), ({"a": a}, {"v": 1}), ({"a": a, "b": b}, {"v": 2})):
        with pytest.raises(ValueError, match="was committed with"):
            commits.publish(spark, root, "one", other, profile=profile)
    assert commits.damaged(spark, root) == []
    attempt = commits.commits(spark, root).where("key = 'one'").first()["attempt"]
    a.limit(1).write.mode("overwrite").parquet(f"{root}/data/a/attempt={attempt}")
    assert commits.damaged(spark, root) == [("one", "a")]
    with pytest.raises(ValueError, match="have changed"):
        commits.publish(spark, root, "one", {"a": a, "b": b}, profile={"v": 1})


def read_on(spark, folder, out, checkpoint, **options):
    run = tailing.growing_lines(spark, f"file://{folder}", **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted((r.file, r.offset, r.value, r.line_sha256) for r in spark.read.schema(tailing.SCHEMA).parquet(out).collect())


def lines_of(files):
    out, sha = [], lambda x: hashlib.sha256(x).hexdigest()
    for name, data in files.items():
        at = 0
        for line in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
            out.append((name, at, line.decode(), sha(line + b"\n")))
            at += len(line) + 1
    return sorted(out)


def test_logs_that_grow_are_read_on(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (folder / "deep").mkdir(parents=True)
    files = {"a.jsonl": b"".join(json.dumps({"n": i, "t": "ü" * (i % 50)}).encode() + b"\n" for i in range(200)), "deep/b.jsonl": b'{"half": '}
    write = lambda: [(folder / n).write_bytes(d) for n, d in files.items()]
    write()
    assert read_on(spark, folder, out, checkpoint, range_bytes=100) == lines_of(files)
    files["deep/b.jsonl"] += b"1}\n\nmore\n" + b"x" * 70_000
    files["c.jsonl"] = b"new\n"
    write()
    assert read_on(spark, folder, out, checkpoint, range_bytes=100) == lines_of(files)
    files["deep/b.jsonl"] += b"y\nlast"
    write()
    assert read_on(spark, folder, out, checkpoint, range_bytes=30_000) == lines_of(files) == read_on(spark, folder, out, checkpoint)
    stored = spark.read.schema(tailing.SCHEMA).parquet(out)
    assert tailing.history_faults(stored, framed.framed_lines(spark, [str(folder), str(folder / "deep")])).collect() == []
    files["a.jsonl"] = b'{"n":1}' + files["a.jsonl"][7:]
    write()  # far before the offset: the whole check finds it
    assert {(r.file, r.offset, r.fault) for r in tailing.history_faults(stored, framed.framed_lines(spark, [str(folder), str(folder / "deep")])).collect()} == {("a.jsonl", 0, "differs")}
    files["c.jsonl"] = b"NEW\nmore\n"
    write()
    with pytest.raises(Exception, match="history changed"):
        read_on(spark, folder, out, checkpoint)


def test_growing_sessions_are_appended(spark, tmp_path):
    folder, table = tmp_path / "logs", str(tmp_path / "table")
    folder.mkdir()
    entry = lambda i: json.dumps({"type": "message", "id": f"e{i}", "parentId": None, "message": {"role": "user", "content": f"t{i}"}}) + "\n"
    text = json.dumps({"type": "session", "id": "s"}) + "\n" + entry(0) + entry(1)[:20]
    for step in (text, text[:-20] + entry(1) + entry(2), text[:-20] + entry(1) + entry(2) + "broken\n"):
        (folder / "s.jsonl").write_text(step)
        go = lambda: sessions.append_growing_sessions(spark, f"file://{folder}", table, str(tmp_path / "cp")).awaitTermination()
        if "broken" in step:
            with pytest.raises(Exception, match="no JSON"):
                go()
        else:
            go()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == ["e0", "e1", "e2", "s"]
