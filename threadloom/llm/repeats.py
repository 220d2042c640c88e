"""Exact substring dedup by prefix-free parsing (operator 9).

Every run of `length` bytes holds a trigger: the least rolling hash of `gram` bytes in it. Triggers depend on nothing
outside the run, so that equal runs have equal triggers at equal places. The runs that share a trigger, one after another,
form a phrase: the bytes from the first run's start to the last run's end. The parse is the list of phrases in corpus
order; the dictionary has each distinct phrase with its first place.

1. Triggers whose gram occurs once in the corpus lead nowhere; only their keys are shuffled, counted before and after.
2. A phrase that stands earlier in the parse is repeated as a whole.
3. What is left are first places of dictionary phrases that share a trigger with a different phrase. Of the dictionary's
   suffix array only the intervals with a common prefix of `length` bytes or more matter; the suffixes, each with its
   first `length` bytes as a hash, are grouped into these intervals, and the least place in an interval, in corpus order,
   is the one that stays.

Repeats inside one text are told apart where the text is read. All else is aggregations with a least id by key, with partial ones before each shuffle, and joins back that
Spark can split; no pairs arise, whatever the number of copies. Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import hashing as H
from threadloom.llm.components import filter_of, passes
from threadloom.llm.shared import shared_table, text_or_empty

U = np.uint64
GRAM = 64
BROADCAST_RUNS = 200_000
#: Stands for a null id, below all others.
NO_ID = -(2**63)


def phrases(texts: pa.Array, length: int, gram: int):
    """For runs of texts: (number of the first text, prefix hash, offsets, text of each phrase, trigger, first and last run)."""
    for first, data, offsets in H.blocks(texts):
        prefix = H.byte_prefix(data)
        if len(data) < length:
            yield first, prefix, offsets, *(np.zeros(0, np.int64),) * 4
            continue
        n = len(data) - gram + 1
        grams = H.mix((prefix[gram:] - prefix[:-gram]) * H._power(H._INVERSE, len(prefix))[:n])
        at, low, high = H.window_minima(grams, offsets[:-1], length - gram + 1, length)
        yield first, prefix, offsets, np.searchsorted(offsets, low, "right") - 1, at, low, high


def trigger_keys(prefix: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    return H.mix(H.span_hash(prefix, at, at + gram) ^ U(0x2545F4914F6CDD1D))


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the runs that start from a to b (included), in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def later_in_text(text: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Which rows have all values of an earlier row of the same text."""
    order = np.lexsort((np.arange(len(text)), *values, text))
    same = np.zeros(len(text), bool)
    if len(text) > 1:
        equal = text[order][1:] == text[order][:-1]
        for v in values:
            equal &= v[order][1:] == v[order][:-1]
        same[order[1:]] = equal
    return same


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (long), spans (array<struct<start, end>>, bytes of the UTF-8 text) and kept
    (binary, the other bytes): one row for each row of docs.

    Removed is every byte inside a run of `length` bytes that also starts earlier: in a text with a smaller id, or earlier
    in the same one. A null text counts as empty; a null id is smaller than any other. Of rows with one id neither is the
    earlier; rows that repeat come back each. An id of -2**63 counts as null. An empty table gives no rows. Of docs only the
    id and the text are read, whatever its other columns are called. Texts are read whole, one block in memory at a time."""
    data = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))
    context = data.sparkSession.sparkContext

    def triggers(batches):
        for batch in batches:
            for _, prefix, _, _, at, _, _ in phrases(batch.column(0), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(trigger_keys(prefix, at, gram)))], ["key"])

    counts = data.select("text").mapInArrow(triggers, "key long").groupBy("key").agg(F.count("*").alias("n"))
    again = shared_table(counts.where("n > 1").select("key"), "repeats-triggers")
    bits = context.broadcast(filter_of(again))

    def parse(batches):
        for batch in batches:
            for first, prefix, offsets, text, at, low, high in phrases(batch.column(1), length, gram):
                key = trigger_keys(prefix, at, gram)
                ok = passes(bits.value, key)
                text, at, low, high, key = text[ok], at[ok], low[ok], high[ok], key[ok]
                phrase = H.mix(H.span_hash(prefix, low, high + length) + (at - low).astype(U) * U(0x9E3779B97F4A7C15))
                rows, begin = pa.array(text + first), offsets[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(H.signed(key)), pa.array(H.signed(phrase)), pa.array(low - begin), pa.array(high - begin), pa.array(later_in_text(text, key, phrase))], ["id", "mark", "key", "phrase", "low", "high", "later"])

    parsed = data.select("id", "text", "mark").mapInArrow(parse, "id long, mark long, key long, phrase long, low long, high long, later boolean")
    parsed = shared_table(parsed.join(again, "key"), "repeats-parse")
    dictionary = parsed.groupBy("key", "phrase").agg(F.min("id").alias("first"))
    others = dictionary.groupBy("key").agg(F.count("*").alias("n"))
    dictionary = shared_table(dictionary.join(others, "key"), "repeats-dictionary")
    later = F.col("later") | (F.col("id") > F.col("first"))
    place = parsed.join(dictionary, ["key", "phrase"]).select("id", "mark", "low", "high", later.alias("later"), "n")
    place = shared_table(place.where("later OR n > 1").drop("n"), "repeats-places")

    def with_runs(table: DataFrame, how: str) -> DataFrame:
        side = table.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("runs")).select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "runs")
        side = F.broadcast(side) if table.count() <= broadcast_runs else side
        return data.join(side, (data["id"] == side["id2"]) & (data["mark"] == side["mark2"]), how).select("id", "mark", "text", "runs")

    def suffixes(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                runs = batch.column(3)[i].values
                low, high = runs.field(0).to_numpy(), runs.field(1).to_numpy()
                for _, bytes_, _ in H.blocks(batch.column(2).slice(i, 1)):
                    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)]))
                    found = H.span_hash(H.byte_prefix(bytes_), starts, starts + length)
                    own = np.zeros(len(starts), np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + i)), batch.column(1).take(pa.array(own + i)), pa.array(H.signed(found)), pa.array(starts), pa.array(later_in_text(own, found))], ["id", "mark", "suffix", "low", "later"])

    suffix = shared_table(with_runs(place.where("not later"), "inner").mapInArrow(suffixes, "id long, mark long, suffix long, low long, later boolean"), "repeats-suffixes")
    interval = shared_table(suffix.groupBy("suffix").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last"), "repeats-intervals")
    shared = context.broadcast(filter_of(interval.select(F.col("suffix").alias("key"))))

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(2).to_numpy().view(U))))

    first_here = suffix.where("not later").select("id", "mark", "suffix", "low").mapInArrow(likely, "id long, mark long, suffix long, low long")
    single = first_here.join(interval, "suffix").where("id > first").unionByName(suffix.where("later"), allowMissingColumns=True).select("id", "mark", "low", F.col("low").alias("high"))
    repeated = shared_table(place.where("later").select("id", "mark", "low", "high").unionByName(single), "repeats-found")

    def cut(batches):
        for batch in batches:
            texts, all_runs = batch.column(2), batch.column(3)
            sizes, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                found = []
                if all_runs[i].is_valid:
                    runs = all_runs[i].values
                    found = covered(list(zip(runs.field(0).to_pylist(), runs.field(1).to_pylist(), strict=True)), length)
                ends = [0, *[x for s in found for x in s], len(text)]
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(text if not found else b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = with_runs(repeated, "left").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
