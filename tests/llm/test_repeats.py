import hashlib
import random

import pytest

from threadloom.llm import repeats


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "bé", "gamma,", "d", "漢字", "e\n", "ffffff", "0"]
    passages = [" ".join(r.choices(words, k=r.randint(20, 80))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choices(words, k=r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 3)
            parts += [p[cut:] if r.random() < 0.5 else p, " ".join(r.choices(words, k=r.randint(0, 5)))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "ab" * 400), (105, "x" * 99), (106, "x" * 100), (107, "x" * 101), (108, "x" * 350)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "gram", "runs"), [(100, 64, 200_000), (100, 20, 0), (60, 40, 0)])
def test_equal_to_brute_force(spark, seed, length, gram, runs):
    rows = corpus(seed)
    shuffled = random.Random(0).sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, length=length, gram=gram, broadcast_runs=runs).collect()}
    assert got == brute(rows, length)


def test_nulls_repeated_rows_and_empty_table(spark):
    text = "".join(map(chr, random.Random(1).choices(range(97, 123), k=180)))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string").selectExpr("*", "'x' AS mark", "1 AS runs")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert got == [(0, 0), (5, 180), (5, 180)]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_digest_is_of_the_bytes_that_stay():
    assert hashlib.sha256(b"".join(b"abcdef"[a:b] for a, b in [(0, 2), (4, 6)])).hexdigest() == hashlib.sha256(b"abef").hexdigest()
    assert repeats.covered([(5, 9), (0, 0), (12, 12)], 3) == [(0, 3), (5, 15)]
