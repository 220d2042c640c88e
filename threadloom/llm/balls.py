"""Centroid clustering of integer vectors by metric trees: whole balls go to a centroid where the triangle inequality lets them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.shared import shared_table

#: Vectors in one tree, vectors at which a ball isn't split any more, the greatest component, the greatest for exact doubles.
TREE, LEAF, MOST, EXACT = 4096, 24, 1 << 27, 1 << 22
TREES = "ids array<long>, vectors binary, first array<int>, end array<int>, child array<int>, radius array<double>, sums binary"


def scaled_vectors(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the rows whose vector has `size` components, none null or non-finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x.cast("double")).isin(float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(v.isNotNull() & (F.size(v) == size) & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _tree(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order of the vectors and the balls of a tree over it: first, end, left child (-1: a leaf; the right one follows), radius
    about the mean (rounded up), integer sum. A ball is split by which of two far vectors each vector is nearer to."""
    order = np.arange(len(vectors))
    first, end, child, radius, sums, todo = [0], [len(vectors)], [-1], [0.0], [None], [0]
    points = vectors.astype(np.float64)
    while todo:
        node = todo.pop()
        a, b = first[node], end[node]
        own = order[a:b]
        x = points[own]
        sums[node] = vectors[own].sum(axis=0)
        center = sums[node] / (b - a)
        off = ((x - center) ** 2).sum(axis=1)
        radius[node] = float(np.sqrt(off.max())) * (1 + 1e-9) + 1e-6
        if b - a <= LEAF or not (x != x[0]).any():
            continue
        one = x[off.argmax()]
        from_one = ((x - one) ** 2).sum(axis=1)
        near = from_one < ((x - x[from_one.argmax()]) ** 2).sum(axis=1)
        order[a:b] = np.concatenate([own[near], own[~near]])
        child[node] = len(first)
        for f, e in ((a, a + int(near.sum())), (a + int(near.sum()), b)):
            todo.append(len(first))
            first.append(f)
            end.append(e)
            child.append(-1)
            radius.append(0.0)
            sums.append(None)
    return order, np.array(first, np.int32), np.array(end, np.int32), np.array(child, np.int32), np.array(radius), np.array(sums, np.int64)


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """A row per tree over up to TREE vectors of one partition, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                if np.abs(v).max(initial=0) > MOST:
                    raise ValueError(f"a component above {MOST}: squared distances wouldn't fit a long")
                order, first, end, child, radius, sums = _tree(v)
                row = [part.column(0).take(pa.array(order)).to_pylist(), v[order].astype("<i4").tobytes(), first.tolist(), end.tolist(), child.tolist(), radius.tolist(), sums.astype("<i8").tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["ids", "vectors", "first", "end", "child", "radius", "sums"])

    return shared_table(vectors.mapInArrow(build, TREES), "trees")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all integer rows of x to all of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT:  # every product and sum is below 2^53
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], axis=1)


def assign(tree: dict, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Balls (node, cluster) that one centroid has whole, and the cluster of every vector of the tree.

    With d the distances from a ball's center, a vector of the ball is d - radius to d + radius away from a centroid: those that
    can't come near enough leave the ball's list, and a ball with one left goes there whole. Others descend; at the leaves the
    distances are exact, and ties go to the smaller number. Bounds leave a margin for the rounding of doubles, which sends a
    doubtful ball further down."""
    first, end, child, radius, vectors = tree["first"], tree["end"], tree["child"], tree["radius"], tree["vectors"]
    center = tree["sums"] / (end - first)[:, None]
    c = centroids.astype(np.float64)
    nodes, can = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    whole: list[tuple[int, int]] = []
    cluster = np.full(len(vectors), -1, np.int32)
    while len(nodes):
        x = center[nodes]
        squares = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :]
        slack = 1e-6 + np.sqrt(squares * 1e-13)  # of a root of a difference of doubles
        d = np.sqrt(np.maximum(squares - 2 * (x @ c.T), 0))
        high = np.where(can, d + slack, np.inf).min(1) + radius[nodes]
        can = can & (d - slack - radius[nodes][:, None] <= high[:, None])
        lone = can.sum(1) == 1
        for n, k in zip(nodes[lone].tolist(), can[lone].argmax(1).tolist(), strict=True):
            whole.append((n, k))
            cluster[first[n] : end[n]] = k
        leaf = ~lone & (child[nodes] < 0)
        at = nodes[leaf]
        if len(at):
            sizes = end[at] - first[at]
            rows = np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            cluster[rows] = distances(vectors[rows], centroids).argmin(1)
        down = ~lone & ~leaf
        nodes = np.concatenate([child[nodes[down]], child[nodes[down]] + 1]).astype(np.int64)
        can = np.concatenate([can[down], can[down]])
    return whole, cluster


def _read(batch: pa.RecordBatch, row: int, size: int) -> dict:
    got = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
    out = {n: np.array(got[n].as_py()) for n in ("first", "end", "child", "radius")}
    out["vectors"] = np.frombuffer(got["vectors"].as_py(), "<i4").reshape(-1, size).astype(np.int64)
    out["sums"] = np.frombuffer(got["sums"].as_py(), "<i8").reshape(-1, size)
    out["ids"] = got["ids"].as_py()
    return out


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: means, rounded down, of their vectors. What comes to the driver is one sum and count for each
    centroid and component, whatever the number of vectors."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [0] * (k * size), np.zeros(k, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _read(batch, row, size)
                whole, cluster = assign(tree, centroids)
                part = np.zeros((k, size), np.int64)
                for node, c in whole:
                    part[c] += tree["sums"][node]
                    cluster[tree["first"][node] : tree["end"][node]] = -1
                    count[c] += tree["end"][node] - tree["first"][node]
                rest = np.flatnonzero(cluster >= 0)
                np.add.at(part, cluster[rest], tree["vectors"][rest])
                count += np.bincount(cluster[rest], minlength=k)
                total = [a + b for a, b in zip(total, part.ravel().tolist(), strict=True)]
        found = np.flatnonzero(np.repeat(count > 0, size))
        decimals = pa.array([total[i] for i in found], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(found // size, pa.int32()), pa.array(found % size, pa.int32()), decimals, pa.array(count[found // size])], names=["cluster", "i", "total", "n"])

    parts = forest.mapInArrow(sums, "cluster int, i int, total decimal(38,0), n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, *, size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every row of vectors (vec_id long, v array<long> of
    `size`, as scaled_vectors gives them).

    Centroids start as the k vectors with the least sha256 of "seed:vec_id" (fewer where there are fewer vectors; equal ids in the
    order of their vectors; a null id counts as an empty one), and move `rounds` times; empty ones stay. Vectors are read into
    metric trees once; rounds read the trees. Equal vectors make a ball of no radius, however many there are. Rows that repeat
    count each; no vectors give no rows; components beyond 2^27 in size are refused."""
    spark: SparkSession = vectors.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    result = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], T.StructType.fromDDL(result + ", cluster_inertia long, inertia long, centroid_sha256 string"))
    centroids = np.array([r["v"] for r in sorted(start, key=lambda r: (r["h"], r["v"]))], np.int64)
    forest = trees(vectors.select("vec_id", "v"), size)
    for _ in range(rounds):
        centroids = moved(forest, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _read(batch, row, size)
                _, own = assign(tree, centroids)
                d = ((tree["vectors"] - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = shared_table(forest.mapInArrow(assigned, result), "assigned")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
