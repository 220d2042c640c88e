"""Document fingerprints by I-Match with randomised lexicons (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import hashing as H
from threadloom.llm.shared import shared_table, text_or_empty, without

U = np.uint64
#: (bits b, lexicons): so many lexicons that each hold a term with a probability of 2**-b. With several sizes, texts of any
#: length have lexicons of which they hold a term or a few.
LEXICONS = ((0, 1), (2, 8), (4, 16), (6, 24), (8, 24))
SIZE = sum(n for _, n in LEXICONS)
MAX_LEXICON = 2_000_000


def distinct_terms(texts: pa.Array):
    """(number of the first text, sorted distinct word hashes of a run of texts, where each text's begin)."""
    for first, data, offsets in H.blocks(texts):
        found, _, _, begins = H.words(data, offsets)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[begins[:-1][begins[:-1] < len(found)]] = True
        yield first, found[new], np.concatenate([[0], np.cumsum(new)])[begins]


def lexicon(docs: DataFrame, *, text_col: str = "text", min_share: float = 0.0002, max_share: float = 0.1, max_terms: int = MAX_LEXICON) -> np.ndarray:
    """Sorted hashes of the terms on min_share to max_share of all texts (two texts at least): a band of inverse document
    frequency.

    Every text is counted. A text has some hundred distinct terms, so that terms on min_share of the texts number at most
    that times 1 / min_share, however many texts there are; where texts are so long that max_terms would be exceeded, the
    lower end of the band rises until they fit. This is what is sent to the executors: 8 * max_terms bytes at most."""

    def count(batches):
        for batch in batches:
            for _, terms, _ in distinct_terms(batch.column(0)):
                found, n = np.unique(terms, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(found)), pa.array(n.astype(np.int64))], ["term", "n"])

    total = docs.count()
    low, high = max(2, min_share * total), max(2, max_share * total)
    counted = docs.select(text_or_empty(text_col)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = shared_table(counted.where((F.col("n") >= low) & (F.col("n") <= high)), "imatch-lexicon")
    while band.where(F.col("n") >= low).count() > max_terms:
        low *= 1.25
    return np.sort(band.where(F.col("n") >= low).select("term").toArrow()["term"].to_numpy().view(U))


def fingerprints(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """A row of SIZE 16-bit numbers for each text; 0 where it has no term of the lexicon.

    A text without terms of the band is told by all its words, one without words is all zeros."""
    out = np.zeros((len(texts), SIZE), np.uint16)
    for first, found, begins in distinct_terms(texts):
        owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        at = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
        known = terms[at] == found if len(terms) else np.zeros(len(found), bool)
        bare = np.bincount(owner[known], minlength=len(begins) - 1) == 0
        use = known | bare[owner]
        found, owner = found[use], owner[use]
        if not len(found):
            continue
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows, j = first + owner[begin], 0
        value = H.mix(found ^ U(0xD6E8FEB86659FD93))
        for bits, lexicons in LEXICONS:
            for i in range(lexicons):
                place = i * bits % (64 - 64 % bits) if bits else 0
                if place == 0:
                    chance = H.mix(found + U(((bits << 16) + i + 1) * 0x9E3779B97F4A7C15 % 2**64))
                member = (chance >> U(place)) & U((1 << bits) - 1) == 0
                held = np.add.reduceat(np.where(member, value, U(0)), begin)
                out[rows, j] = np.where(held == 0, 0, H.mix(held) >> U(48) | U(1))
                j += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers among those of lexicons of which either text holds a term; 1 where neither holds any."""
    either = (a != 0) | (b != 0)
    return np.where(either.any(1), ((a == b) & either).sum(1) / np.maximum(either.sum(1), 1), 1.0)


def as_text(found: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in found.astype(">u2")], pa.string())


def fingerprint(docs: DataFrame, *, text_col: str = "text", terms: np.ndarray | None = None, **band) -> DataFrame:
    """docs with fingerprint: SIZE numbers of four hexadecimal digits. A null or empty text has zeros only; rows that repeat
    get equal fingerprints. A column named fingerprint gives way, other columns stay.

    Nothing but term counts is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col=text_col, **band) if terms is None else terms)

    @F.pandas_udf("string")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(as_text(fingerprints(pa.array(batch, pa.string()), sent.value)).to_pylist(), dtype=object)

    return without(docs, "fingerprint").withColumn("fingerprint", make(text_or_empty(text_col)))


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, **band) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs: its text,
    the text with its last half replaced by the start of the next text in order of id (after the last: the first), and the
    likeness of its fingerprint to those of the edited and of the next text.

    Rows are dealt by ranges of ids, bounded by quantiles; each range also gets the row that follows it. Within a range
    rows come in falling order, so that one text, the next one, is held. Of rows with one id, the one whose text has the
    least hash is the next of the ids before; a null id comes before all others. Only ids' quantiles and the first id of
    each range, a few numbers for each range, reach the driver. An id of -2**63 counts as null. An empty table gives no rows."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text_col=text_col, **band))
    data = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), text_or_empty(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    ids = data.select("id")
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    block = F.lit(0)
    if cuts:
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id")))
    firsts = sorted((r["block"], r["id"]) for r in ids.groupBy(block.alias("block")).agg(F.min("id").alias("id")).collect())
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    #: The row that follows a range stands in the next one, or after the last in the first.
    before = {firsts[(i + 1) % len(firsts)][1]: firsts[i][0] for i in range(len(firsts))}
    copies = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    own = data.withColumn("block", block).withColumn("copy", F.lit(False))
    follow = data.where(F.col("id").isin(*before)).withColumn("block", F.element_at(copies, F.col("id"))).withColumn("copy", F.lit(True))
    dealt = own.unionByName(follow).repartition(n, "block").sortWithinPartitions("block", F.desc("copy"), F.desc("id"), F.desc("mark"))

    def edit(batches):
        import hashlib

        block = at = next_text = held = None
        for batch in batches:
            rows = []
            for i, text, b, copy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != block:
                    block, at, next_text, held = b, None, None, None
                if not copy:
                    if i != at:
                        next_text = held
                        at = i
                    half = len(text) // 2
                    rows.append((i, text, text[: len(text) - half] + next_text[:half], next_text))
                held = text
            for j in range(0, len(rows), 500):
                part = rows[j : j + 500]
                texts = pa.array([x for r in part for x in r[1:]], pa.large_string())
                found = fingerprints(texts, terms.value)
                own, edited, following = found[0::3], found[1::3], found[2::3]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([len(r[1]) for r in part], pa.int64()),
                        pa.array([hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in part]),
                        as_text(own),
                        as_text(edited),
                        pa.array(likeness(own, edited)),
                        pa.array(likeness(own, following)),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    out = dealt.select("id", "text", "block", "copy").mapInArrow(edit, schema)
    return out.withColumn("id", F.when(F.col("id") != -(2**63), F.col("id"))).withColumnRenamed("id", id_col)
