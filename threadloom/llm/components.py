"""Connected components and keys that occur more than once, by joins and aggregations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import shared_table

#: Bits of the filter that repeated_keys makes: its size is fixed, whatever the number of keys.
FILTER_BITS = 26
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for all nodes of edges (a long, b long).

    Large-star and small-star steps alternate until no edge changes. Each is an aggregation by node with partial sums and
    a join with the result, whose skewed side Spark can split; edges are written to the shared folder after each round."""
    edges = shared_table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = shared_table(small.unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for the top FILTER_BITS bits of every key (long), as unsigned 64-bit words.

    A key whose bit is unset isn't there. At most 2**(FILTER_BITS - 6) words reach the driver; with very many keys the
    filter lets everything pass, and the join that follows it does all the work."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    words = keys.select(F.shiftrightunsigned(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys may be among those of filter_of."""
    at = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
