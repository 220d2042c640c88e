"""Extra columns with the names of results or of anything else, repeated rows, empty tables and very long texts."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom.llm import credentials, imatch, jaccard, licenses, lines, packing, passages, pieces, repeats
from threadloom.llm.queries import MODEL_FILE


def model():
    with open(MODEL_FILE, "rb") as f:
        return f.read()


CASES = {
    "secrets": (credentials.scan_secrets, ["secrets"]),
    "redact": (credentials.redact, []),
    "licenses": (licenses.scan_licenses, ["license_digest", "license_id", "notices", "n_license_lines"]),
    "pieces": (lambda d: pieces.decode(pieces.encode(d, model()), model()), ["ids", "decoded"]),
    "packing": (lambda d: packing.pack(d, keep=tuple(d.columns)), ["n_tokens", "bucket", "padded_length", "batch_id", "slot"]),
    "jaccard": (lambda d: jaccard.jaccard_components(d), ["n_shingles", "component_id"]),
    "one_of_each": (lambda d: jaccard.one_of_each(d), []),
    "quality": (lines.quality_rules, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept"]),
    "lines": (lines.drop_frequent_lines, ["n_lines", "n_dropped"]),
    "fingerprint": (imatch.fingerprint, ["fingerprint"]),
    "edited": (imatch.edited_pairs, ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    "repeats": (lambda d: repeats.remove_repeats(d), ["n_bytes", "n_removed", "n_spans", "spans", "kept"]),
    "passages": (lambda d: passages.summary(d, passages.near_passages(d)), ["n_passages", "n_near_bytes", "spans", "partners"]),
}
EXTRA = ["id", "cls", "key", "mark", "n", "text_", "words", "gone", "host", "frequent", "canonical", "hits", "block", "copy", "component", "node", "term", "line", "page", "rows", "at", "chunk", "before", "__text", "tid", "cell", "partner", "s", "m", "digest"]
LONG = " ".join("w%d" % (i * i % 9973) for i in range(60_000))
ROWS = [(1, "password=abcdefghijkl12 and more", "a"), (2, None, "a"), (2, None, "a"), (3, "", None), (4, LONG, "b"), (4, LONG, "b"), (5, LONG[:1000], "b"), (None, "x y z", "b"), (7, "Released under the MIT License.", "a")]


@pytest.mark.parametrize("name", CASES)
def test_clashing_names_change_nothing(spark, name):
    run, results = CASES[name]
    if name == "pieces" and not os.path.exists(MODEL_FILE):
        pytest.skip("no model file")
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    low = {r.lower() for r in results}
    extra = [e for e in EXTRA if e not in low]
    crowded = plain.select("*", *[F.lit("own").alias(c) for c in [*(r.upper() if i % 2 else r for i, r in enumerate(results)), *extra]])
    want, got = run(plain), run(crowded)
    names = [c for c in got.columns if c in want.columns]
    assert sorted(names) == sorted(want.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    shown = lambda d: sorted(map(str, d.select(*sorted(want.columns)).collect()))
    assert shown(got) == shown(want)
    kept = [c for c in got.columns if c in extra and c not in want.columns]
    assert all(r[c] == "own" for r in got.select(*kept).collect() for c in kept)
    empty = run(plain.limit(0))
    assert empty.collect() == [] and empty.columns == want.columns
