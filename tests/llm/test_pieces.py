import os
import random

import pyarrow as pa
import pytest

from threadloom.llm import pieces
from threadloom.llm.queries import MODEL_FILE

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")


@pytest.fixture(scope="module")
def model():
    with open(MODEL_FILE, "rb") as f:
        return f.read()


def texts(n=400):
    r = random.Random(2)
    alphabet = "aaaabbc  \n\tétß漢字😀1234the of ingtion#$%&!"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 70))) for _ in range(n)] + ["", " ", "   lead", "a" * 500, "= = = =", "-" * 90, "<s>", "<0x0A>"]


@pytest.mark.parametrize("by_word", [True, False])
def test_ids_equal_the_librarys_and_decode_to_the_text(model, by_word):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=model)
    coder = pieces.Encoder(pieces.Vocabulary(model))
    if not by_word:
        coder.split = None
    batch = pa.array([*texts(), "a▁b ▁▁c", "▁", "漢" * 300 + " " * 70 + "x"])
    ids = coder.encode(batch)
    assert ids.to_pylist() == [library.encode(text) for text in batch.to_pylist()]
    assert coder.decode(ids).to_pylist() == [text.replace("▁", " ") for text in batch.to_pylist()]
    assert coder.encode(batch.slice(5, 3)).to_pylist() == ids.to_pylist()[5:8] and coder.decode(ids.slice(5, 3)).to_pylist() == batch.to_pylist()[5:8]


def test_bytes_that_are_no_text(model):
    coder = pieces.Encoder(pieces.Vocabulary(model))
    ids = coder.encode(pa.array([" 𓀀"])).to_pylist()[0]
    assert coder.decode(pa.array([ids, ids[:-1], []], pa.list_(pa.int32()))).to_pylist() == [" 𓀀", " \ufffd", ""]


def test_unigram_search_equals_the_whole_lattice(model):
    v = pieces.Vocabulary(model)
    v.model_type = pieces.UNIGRAM
    coder = pieces.Encoder(v)
    for text in texts(150):
        text = v.normal(text)
        best = [0.0] + [None] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - v.longest), j):
                at = v.ids.get(text[i:j])
                if at is not None or j == i + 1:
                    score = best[i] + (v.penalty if at is None else v.scores[at])
                    best[j] = score if best[j] is None else max(best[j], score)
        got = [p for part in coder.stream(text) for p in part]
        assert "".join(map(coder.text_of, got)) == text
        assert sum(v.penalty if p < 0 else v.scores[p] for p in got) == best[-1]


def test_columns(spark, model):
    docs = spark.createDataFrame([(1, "hello wörld\n", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids_ string").selectExpr("*", "0 AS ids", "1 AS Decoded", "2 AS text_", "3 AS `a b`")
    coded = pieces.decode(pieces.encode(docs, model), model)
    assert coded.columns == ["doc_id", "text", "ids_", "text_", "a b", "ids", "decoded"]
    assert pieces.decode(pieces.encode(docs.limit(0), model), model).collect() == []
    assert [r["decoded"] for r in pieces.decode(docs.selectExpr("doc_id", "cast(null AS array<int>) AS ids"), model).collect()] == [None] * 3
    assert [(r["doc_id"], r["ids_"], r["decoded"]) for r in coded.orderBy("doc_id").collect()] == [(1, "x", "hello wörld\n"), (2, "y", ""), (3, "z", "")]
