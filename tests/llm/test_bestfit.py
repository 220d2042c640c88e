"""Best-fit packing and its tokens, against the library and plain best-fit decreasing."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bestfit
from threadloom.llm.byte_tokens import ByteTokenizer
from threadloom.llm.queries import VOCABULARY_FILE

needs_file = pytest.mark.skipif(not os.path.exists(VOCABULARY_FILE), reason="no vocabulary file")


def plain(counts, capacity):
    left = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, x in enumerate(left) if x >= length]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= length
            else:
                left.append(capacity - length)
    return sorted(left)


def test_plans_are_best_fit_decreasing():
    rnd = random.Random(0)
    for _ in range(200):
        capacity = rnd.choice([1, 2, 7, 16, 33, 100])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(0, 12))}
        bins = {}
        for length, first, end, number, each, offset in bestfit.best_fit(counts, capacity):
            for r in range(first, end):
                bins.setdefault(number + (r - first) // each, []).append((offset + (r - first) % each * length, length))
        for held in bins.values():
            assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))]
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == plain(counts, capacity)
    assert len(bestfit.best_fit(dict.fromkeys(range(1, 2049), 10**9), 2048)) < 10_000


@needs_file
def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    rnd, own, library = random.Random(1), ByteTokenizer(VOCABULARY_FILE), Tokenizer.from_file(VOCABULARY_FILE)
    letters = "ab's tmdrevl'  \n\t1!é 　日²\U0001f600́​\x85'"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(32, 127)])) for _ in range(20)) for _ in range(500)]
    texts += ["x" * 5000, "a<|endoftext|>b", None, "", "aaaaaaaaaaaaaaa aaaaaaa", " ", "'", "it's we'll", "'sabc"]
    ids, starts = own.ids(pa.array(texts))
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[starts[i] : starts[i + 1]].tolist() == e.ids, texts[i]


@needs_file
def test_pieces_lie_in_sequences(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY_FILE)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "naïve", "x1"]) for _ in range(rnd.randrange(60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "same text again"), (1002, "same text again"), (None, "no id"), (1003, "w " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("own") for c in ("IDS", "offset", "task", "at", "__text2")})
    pieces = bestfit.cut(docs, VOCABULARY_FILE, capacity=64)
    placed = bestfit.place(pieces, capacity=64)
    assert placed.columns == ["doc_id", "task", "at", "__text2", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = placed.collect()
    whole = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.task == "own"
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    for doc, text in rows:
        want, parts = [*library.encode(text or "", add_special_tokens=False).ids, 0], sorted(whole[doc])
        if doc == 1002:
            parts = [p for p in parts[: len(parts) // 2]]
        assert sum((p[2] for p in parts), []) == want and [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:i]) for i in range(len(parts))]
        assert all(len(p[2]) == 64 for p in parts[1:])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    counts = {}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
            counts[length] = counts.get(length, 0) + 1
        assert at <= 64
    assert sorted(64 - sum(n for _, n in b) for b in bins.values()) == plain(counts, 64)
    assert bestfit.place(bestfit.cut(docs.limit(0), VOCABULARY_FILE)).collect() == []
    crc = pieces.select(F.crc32("ids").alias("c"), "ids").first()
    assert crc.c == zlib.crc32(crc.ids)
