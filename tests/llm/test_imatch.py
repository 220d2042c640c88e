import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import imatch


def rows_of(n=80, seed=4):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    rows = [(i * 3, " ".join(r.choices(words, k=r.choice([0, 1, 5, 60, 300])))) for i in range(n)]
    rows[7] = (21, rows[6][1])
    rows[9] = (27, None)
    return rows


@pytest.mark.parametrize("blocks", [1, 5])
def test_edits_follow_the_order_of_ids(spark, blocks):
    rows = rows_of()
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.edited_pairs(docs, blocks=blocks).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    assert got[18]["fingerprint"] == got[21]["fingerprint"] and got[18]["near_next"] == 1
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long])


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, "all " + ("some " if i < 4 else "") + f"own{i}") for i in range(20)], "doc_id long, text string")
    assert len(imatch.lexicon(docs, max_share=0.5)) == 1
    assert len(imatch.lexicon(docs, max_share=1.0)) == 2
    assert len(imatch.lexicon(docs, max_share=1.0, max_terms=1)) == 1


def test_single_row_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e f g")], "doc_id long, text string").selectExpr("*", "0 AS block", "false AS copy")
    got = sorted((r["doc_id"] or -1, r["n_chars"]) for r in imatch.edited_pairs(docs).collect())
    assert got == [(-1, 7), (1, 5), (1, 5)]
    assert imatch.edited_pairs(docs.where("doc_id = 1").limit(1)).collect()[0]["near_next"] == 1
    assert imatch.edited_pairs(docs.limit(0)).collect() == []
    assert [r["fingerprint"] for r in imatch.fingerprint(docs, terms=np.zeros(0, np.uint64)).collect()][0].strip("0")
