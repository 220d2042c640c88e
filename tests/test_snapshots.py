"""Presence by runs and ordered digests, against plain loops."""

import hashlib
import random

from threadloom.operators import snapshots, validation


def test_presence_runs_and_what_they_write_out(spark):
    rnd = random.Random(5)
    for n in (0, 1, 7):
        captures = [(f"s{i}", rnd.randrange(4)) for i in range(n)]
        order = [s for s, at in sorted(captures, key=lambda x: (x[1], x[0]))]
        seen = [(s, who) for s, _ in captures for who in ("a", "b", "c", "d") if rnd.random() < 0.5] * 2 + [("unknown", "a")]
        obs = spark.createDataFrame(seen, "snapshot string, identity string")
        snaps = spark.createDataFrame(captures, "snapshot string, captured_at int")
        have = {(s, w) for s, w in seen}
        absences, history = set(), set()
        for who in ("a", "b", "c", "d", "never"):
            prior = None
            for s in order:
                if (s, who) in have:
                    prior, state = s, "present"
                elif prior:
                    absences.add((s, who, prior))
                    state = "absent_in_snapshot"
                else:
                    state = "unknown"
                history.add((who, s, state))
        got = snapshots.source_absences(obs, snaps).collect()
        assert {tuple(r) for r in got} == absences and len(got) == len(absences)
        asked = spark.createDataFrame([(w,) for w in ("a", "b", "c", "d", "never", "a")], "identity string")
        got = snapshots.presence_history(obs, snaps, asked).collect()
        assert {tuple(r) for r in got} == history and len(got) == len(history)
        runs = snapshots.presence_runs(obs, snaps)
        spread = {(r["identity"], order[k - 1], r["state"]) for r in runs.collect() for k in range(r["first"], r["last"] + 1)}
        assert spread == {(w, s, {"present": "present", "absent_in_snapshot": "absent"}[x]) for w, s, x in history if x != "unknown"}
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def chained(parts):
    h = hashlib.sha256()
    for p in parts:
        h.update(p or b"")
    return h.hexdigest()


def test_ordered_and_block_digests(spark):
    rnd = random.Random(6)
    rows = [(g, i, None if rnd.random() < 0.1 else rnd.randbytes(rnd.randrange(5))) for g in ("a", "b", "", None) for i in range(rnd.randrange(1, 400))] + [("dup", 1, b"y"), ("dup", 1, b"x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v binary").repartition(7)
    by = {}
    for g, i, v in sorted(rows, key=lambda r: (r[1], r[2] or b"")):
        by.setdefault(g, []).append((i, v))
    got = {r.g: (r.n, r.digest) for r in validation.ordered_digests(df, group="g", order="i", value="v").collect()}
    assert got == {g: (len(x), chained(v for _, v in x)) for g, x in by.items()}
    got = {r.g: (r.n, r.digest) for r in validation.block_digests(df, group="g", order="i", value="v", block=50).collect()}
    want = {}
    for g, x in by.items():
        blocks = {}
        for i, v in x:
            blocks.setdefault(i // 50, []).append(v)
        want[g] = (len(x), chained(bytes.fromhex(chained(blocks[b])) for b in sorted(blocks)))
    assert got == want
    assert validation.ordered_digests(df.limit(0), group="g", order="i", value="v").collect() == []


def test_store_and_run_digests(spark):
    rows = [(s, i, "%064x" % (i + 7), "%064x" % (i * i)) for s in ("zeta", "äpfel") for i in range(30)]
    df = spark.createDataFrame(rows, "store string, cursor_ordinal long, canonical_row_sha256 string, decoded_value_sha256 string").repartition(5)
    stores = validation.store_digests(df)
    want = {s: chained(f"{i}\0{a}\0{b}\0".encode() for x, i, a, b in rows if x == s) for s in ("zeta", "äpfel")}
    assert {r.store: r.digest for r in stores.collect()} == want
    one = validation.run_digest(stores).collect()
    assert [(r.n, r.digest) for r in one] == [(2, chained(f"{s}\0{30}\0{want[s]}\0".encode() for s in sorted(want, key=str.encode)))]
