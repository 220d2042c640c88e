"""Best-fit packing: documents as token sequences, packed whole into as few sequences of a fixed capacity as best fit makes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window

from threadloom.llm.byte_tokens import ByteTokenizer
from threadloom.llm.shared import columns, shared_table, unused, without

PIECE_COLUMNS = ("piece", "start", "length", "ids")
PLACE_COLUMNS = ("sequence_id", "offset")


class OpenBins:
    """Open bins by remaining capacity, as ranges of bin numbers; a segment tree over the capacities knows which have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, left: int, any_open: bool) -> None:
        node = left + self.leaves
        self.tree[node] = any_open
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] | self.tree[2 * node + 1]

    def push(self, left: int, first: int, n: int) -> None:
        if left and n:
            self.ranges[left].append((first, n))
            self._mark(left, True)

    def pop(self, left: int) -> tuple[int, int]:
        got = self.ranges[left].pop()
        if not self.ranges[left]:
            self._mark(left, False)
        return got

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length that a bin has: up while nothing is to the right, then down."""
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1 and (node & 1 or not self.tree[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length: rows (length, first, end, bin, each, offset), by which the
    piece of rank r, first <= r < end, goes to bin + (r - first) // each, at offset + (r - first) % each * length.

    Pieces of one length are placed together: a bin that was the tightest stays so until it can hold no more of that length, so
    that the rows say what one piece after the other would do. Their number is bounded by the capacity (a few for each length
    and range of bins), not by the counts."""
    bins, steps, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                bins.push(capacity, made, n)
                made += n
                continue
            first, n = bins.pop(room)
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, rank + full * each, first, each, capacity - room))
                bins.push(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer pieces than one bin takes
                steps.append((length, rank, rank + left, first, left, capacity - room))
                bins.push(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            bins.push(room, first, n)
    return steps


def cut(docs: DataFrame, tokenizer_file: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece of every document: docs' other columns, piece, start, length, ids (little-endian unsigned 32-bit).

    A document's ids are those of the whole text, then end_id. Up to `capacity` ids are one piece; a longer document is cut into
    pieces of `capacity` ids, of which the first may be shorter. Null and empty texts are one piece, end_id alone. Rows that
    repeat are documents of their own; an empty table gives none; columns of docs with a result's name give way."""
    kept = without(docs, *PIECE_COLUMNS)
    own = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids, starts = tokenizer.ids(batch.column(0))
                total = np.diff(starts) + 1
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                stream = np.insert(ids, starts[1:], end_id).astype("<u4")
                begin = starts[:-1][row] + row + start  # every text before adds one end_id
                offsets = np.append(begin, len(stream)).astype(np.int64) * 4
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(stream)])
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in batch.columns[1:]], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data.cast(pa.binary())], names=schema.names)

    named = dict(zip(kept.columns, columns(kept), strict=True))
    return kept.select(named[text].cast("string").alias("__text"), *[named[f.name] for f in own]).mapInArrow(pieces, schema)


#: Documents that are tokenised at once.
SLICE = 1000

_tokenizers: dict[str, ByteTokenizer] = {}


def _tokenizer(file: str) -> ByteTokenizer:
    if file not in _tokenizers:
        _tokenizers[file] = ByteTokenizer(file)
    return _tokenizers[file]


def place(pieces: DataFrame, *, capacity: int = 2048, length: str = "length") -> DataFrame:
    """pieces (each of 1 to `capacity` tokens) with sequence_id and offset, by best-fit decreasing over all of them.

    Only counts by length go to the driver (`capacity` rows at most), and the plan that best_fit makes of them goes back to the
    executors; neither grows with the number of pieces. A piece's rank among those of its length is its rank within the task
    that wrote it and the number in earlier tasks, so that no length's pieces meet in one place. Which of several pieces of one
    length goes where is arbitrary. Repeated rows are pieces of their own; an empty table stays empty; columns named sequence_id
    or offset give way."""
    spark, kept = pieces.sparkSession, without(pieces, *PLACE_COLUMNS)
    task, at = unused(kept, "task"), unused(kept, "at")
    stored = shared_table(kept.withColumns({task: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "pieces")
    per = stored.groupBy(length, task).agg(F.count("*").alias("n"))
    earlier = window.Window.partitionBy(length).orderBy(task).rowsBetween(window.Window.unboundedPreceding, -1)
    base = per.select(F.col(length).alias("__length"), F.col(task).alias("__task"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    counts = {int(r[0]): int(r[1]) for r in per.groupBy(length).agg(F.sum("n")).collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    plan = spark.createDataFrame(best_fit(counts, capacity), "__l long, __first long, __end long, __bin long, __each long, __offset long")
    within = window.Window.partitionBy(task, length).orderBy(at)
    ranked = stored.withColumn("__within", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col(task) == F.col("__task")) & (F.col(length) == F.col("__length"))).withColumn("__rank", F.col("__base") + F.col("__within"))
    step = F.col("__rank") - F.col("__first")
    found = ranked.join(F.broadcast(plan), (F.col(length) == F.col("__l")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    return found.select(*columns(kept), (F.col("__bin") + F.floor(step / F.col("__each"))).alias("sequence_id"), (F.col("__offset") + step % F.col("__each") * F.col(length)).alias("offset"))
