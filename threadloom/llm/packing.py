"""Packing into optimal length buckets (operator 4)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import shared_table, text_or_empty, unused, word_count


def choose_boundaries(histogram: Iterable[tuple[int, int]], buckets: int, multiple_of: int = 1) -> list[int]:
    """The at most `buckets` padded lengths that make the padding of all documents least.

    histogram: (length, documents). Each boundary is a multiple of multiple_of; the last holds the longest length. The
    padding of a bucket that ends at b is b * documents - their lengths, so that for a fixed number of buckets each state
    of the dynamic program is the least of lines in b; both slopes and b are monotonic, and a deque holds the hull."""
    rounded: dict[int, list[int]] = {}
    for length, count in histogram:
        b = max(1, -(-length // multiple_of)) * multiple_of
        at = rounded.setdefault(b, [0, 0])
        at[0] += count
        at[1] += count * length
    ends = sorted(rounded)
    if not ends:
        return [multiple_of]
    docs, mass = [0], [0]
    for b in ends:
        docs.append(docs[-1] + rounded[b][0])
        mass.append(mass[-1] + rounded[b][1])
    n = len(ends)
    best: list[int | None] = [0] + [None] * n
    came: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, state
        now: list[int | None] = [0] + [None] * n
        back = [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m, c = -docs[j - 1], best[j - 1] + mass[j - 1]
                while len(hull) > 1 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, j - 1))
            x = ends[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                now[j], back[j] = hull[0][0] * x + hull[0][1] + x * docs[j] - mass[j], hull[0][2]
        came.append(back)
        best = now
    out, j = [], n
    for back in reversed(came):
        if j:
            out.append(ends[j - 1])
            j = back[j]
    return out[::-1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, keep: tuple[str, ...] = (), buckets: int = 16, token_budget: int = 32_768, multiple_of: int = 8, chunk_rows: int = 16_384) -> DataFrame:
    """id_col, the columns of keep, n_tokens, bucket (int), padded_length, batch_id, slot (long): each row's place.

    n_tokens is length_col, or the words of text_col; null counts as 0. The histogram of all lengths below token_budget
    (at most token_budget rows, whatever the number of documents) goes to the driver, where dynamic programming chooses
    the bucket boundaries of least padding. A batch has the rows of one bucket, token_budget // padded_length of them; only
    the last batch of a bucket may have fewer. A row of token_budget or more tokens is a batch of its own, in bucket
    -1, padded to a multiple of multiple_of.

    Rows are numbered without a global sort: they fall into chunks of about chunk_rows by a hash, are numbered within
    bucket and chunk, and get the rows of earlier chunks of the bucket added. Rows that repeat each get a slot. Where ids
    tie, the text's hash and then the length decide. An empty table gives an empty result. Columns of keep with a result's
    name give way to it."""
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")) if length_col else word_count(text_or_empty(text_col))
    mark = F.xxhash64(F.col(id_col), *([F.col(text_col)] if text_col in docs.columns else []))
    results = ("n_tokens", "bucket", "padded_length", "batch_id", "slot")
    if id_col.lower() in results:
        raise ValueError(f"{id_col} is the name of a result")
    keep = tuple(c for c in keep if c != id_col and c.lower() not in results)
    own = docs.select(id_col, *keep)
    mark_, chunk_, n_, before_, at_ = (unused(own, x) for x in ("mark", "chunk", "rows", "before", "at"))
    rows = shared_table(docs.select(F.col(id_col), *[F.col(c) for c in keep], length.alias("n_tokens"), mark.alias(mark_)), "packing-lengths")
    small = F.col("n_tokens") < token_budget
    histogram = [(r["n_tokens"], r["n"]) for r in rows.groupBy(F.when(small, F.col("n_tokens")).alias("n_tokens")).agg(F.count("*").alias("n")).collect()]
    total, histogram = sum(n for _, n in histogram), [x for x in histogram if x[0] is not None]
    ends = choose_boundaries(histogram, buckets, multiple_of)
    held = [0] * len(ends)
    for n_tokens, n in histogram:
        held[next(i for i, b in enumerate(ends) if n_tokens <= b)] += n
    fits = [max(1, token_budget // b) for b in ends]
    first, start = [], 0
    for n, fit in zip(held, fits, strict=True):
        first.append(start)
        start += -(-n // fit)
    chunks = max(1, -(-total // chunk_rows))
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(i)) for i, b in enumerate(ends[:-1])], F.when(small, F.lit(len(ends) - 1)), F.lit(-1))
    rows = rows.withColumn("bucket", bucket).withColumn(chunk_, F.pmod(mark_, F.lit(chunks)))
    sizes = rows.groupBy("bucket", chunk_).agg(F.count("*").alias(n_))
    before = sizes.select("bucket", chunk_, (F.sum(n_).over(Window.partitionBy("bucket").orderBy(chunk_)) - F.col(n_)).alias(before_))
    order = Window.partitionBy("bucket", chunk_).orderBy(F.col(id_col), mark_, "n_tokens")
    at = rows.withColumn(at_, F.row_number().over(order)).join(before, ["bucket", chunk_]).withColumn(at_, F.col(at_) + F.col(before_) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    alone = F.col("bucket") < 0
    out = at.withColumn("padded_length", F.when(alone, F.ceil(F.col("n_tokens") / multiple_of) * multiple_of).otherwise(pick(ends)))
    out = out.withColumn("batch_id", F.when(alone, F.lit(start) + F.col(at_)).otherwise(pick(first) + F.floor(F.col(at_) / pick(fits)))).withColumn("slot", F.when(alone, F.lit(0)).otherwise(F.col(at_) % pick(fits)).cast("long"))
    return out.select(id_col, *keep, "n_tokens", "bucket", F.col("padded_length").cast("long").alias("padded_length"), "batch_id", "slot")
