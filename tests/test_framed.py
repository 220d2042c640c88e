"""Framed lines and JSON arrays with splits inside of lines, strings and elements, against whole files."""

import hashlib
import json
import random

import pytest

from threadloom.sources import framed


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_have_numbers_and_places(small_splits, tmp_path):
    rnd, files = random.Random(1), {}
    for name in ("a", "b c"):
        files[name] = b"".join(json.dumps({"n": i, "t": "é\r" * rnd.randrange(60)}, ensure_ascii=False).encode() + b"\n" for i in range(50))
    files["open"] = b'{"a":1}\n{"b":2}'
    files["bad"] = b'{"a":1}\n\n[1]\n{"a":1,"a":2}\nnot\n{}\n'
    for name, data in files.items():
        (tmp_path / f"{name}.ndjson").write_bytes(data)
    lines = framed.framed_lines(small_splits, str(tmp_path))
    rows = {}
    for r in lines.collect():
        rows.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " ")[:-7], []).append(r)
    assert lines.rdd.getNumPartitions() >= 1 and set(rows) == {"a", "b c", "open", "bad"}
    for name, got in rows.items():
        at = 0
        for i, (r, want) in enumerate(zip(sorted(got, key=lambda r: r.ordinal), files[name].splitlines(keepends=True) if name not in ("a", "b c") else [x + b"\n" for x in files[name].split(b"\n")[:-1]], strict=True)):
            assert (r.ordinal, r.offset, r.n_bytes, r.line_sha256) == (i, at, len(want), hashlib.sha256(want).hexdigest())
            at += len(want)
    assert {(n, r.ordinal, r.problem) for n, x in rows.items() for r in x if r.problem} == {("open", 1, "unterminated"), ("bad", 1, "blank"), ("bad", 2, "not_object"), ("bad", 3, "not_object"), ("bad", 4, "not_object")}
    report = {r.file.rsplit("/", 1)[1][:-7]: (r.n_lines, r.n_bytes, r.fault) for r in framed.scan_report(lines, framed.file_states(small_splits, str(tmp_path))).collect()}
    assert report["a"] == (50, len(files["a"]), None) and report["open"][2] == "unterminated@1" and report["bad"] == (6, len(files["bad"]), "blank@1")
    digests = {r.file.rsplit("/", 1)[1].replace("%20", " ")[:-7]: r.digest for r in framed.file_digests(lines).collect()}
    assert digests == {n: hashlib.sha256(d).hexdigest() for n, d in files.items() if d}


def test_a_file_that_changes_is_told(small_splits, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_bytes(b"{}\n" * 40)
    lines = framed.framed_lines(small_splits, str(tmp_path))
    seen = small_splits.createDataFrame(lines.collect(), lines.schema)
    path.write_bytes(b"{}\n" * 41)
    assert [r.fault for r in framed.scan_report(seen, framed.file_states(small_splits, str(tmp_path))).collect()] == ["moved"]


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return rnd.choice([None, True, -1.5e3, 12])
    if kind < 4:
        return "".join(rnd.choice('ab,"\\[]{}:é\n ') for _ in range(rnd.randrange(30)))
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {f"k{i},[\"": value(rnd, depth + 1) for i in range(rnd.randrange(4))}


def test_elements_of_arrays_by_many_splits(small_splits, tmp_path):
    rnd, want = random.Random(2), {}
    for n in range(8):
        want[f"f{n}"] = [value(rnd) for _ in range(rnd.randrange(40))]
        (tmp_path / f"f{n}.json").write_text((" \n" if n % 2 else "") + json.dumps(want[f"f{n}"], ensure_ascii=bool(n % 3), indent=1 if n % 4 == 0 else None) + "\n" * (n % 2))
    got = {f"f{n}": {} for n in range(8)}
    for r in framed.array_elements(small_splits, str(tmp_path)).collect():
        assert r.error is None
        got[r.file.rsplit("/", 1)[1][:-5]][r.array_index] = json.loads(r.value)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want and all(sorted(v) == list(range(len(v))) for v in got.values())


def test_what_is_no_array_is_told(spark, tmp_path):
    texts = ["{}", "[1,2", '["a]', "x[1]", "[1]y", '["a","b]', "1", "]["]
    for i, text in enumerate([*texts, "[]", " [ ] ", '["[\\"]"]', "[[],[]]"]):
        (tmp_path / f"{i}.json").write_text(text)
    got = framed.array_elements(spark, str(tmp_path))
    name = lambda r: int(r.file.rsplit("/", 1)[1][:-5])
    assert {name(r) for r in got.where("error IS NOT NULL").collect()} == set(range(len(texts)))
    assert sorted((name(r), r.array_index, r.value) for r in got.collect() if name(r) >= len(texts)) == [(10, 0, '"[\\"]"'), (11, 0, "[]"), (11, 1, "[]")]
