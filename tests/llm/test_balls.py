"""Clustering by ball trees, against plain assignment."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import balls


def plain(rows, k, rounds, seed=2):
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(nearest(v)[1], []).append(v)
        for i, vs in own.items():
            centroids[i] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in rows]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(x for _, y, x in found if y == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("wide", [3, 40, 1 << 24])
def test_clusters_are_exact(spark, wide):
    rnd = random.Random(wide)
    middles = [[rnd.randint(-wide, wide) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rnd.randint(-2, 2) for x in rnd.choice(middles)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(5, rows[9][1])] * 3 + [(None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    got = balls.cluster(df, size=4, k=9, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 9, 3)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, v array<long>")
    assert sorted(map(tuple, balls.cluster(df, size=2).collect())) == plain([(1, [1, 2]), (2, [3, 4])], 40, 5)
    none = balls.cluster(df.limit(0), size=2)
    assert none.collect() == [] and none.columns == balls.cluster(df, size=2).columns
    with pytest.raises(Exception, match="wouldn't fit"):
        balls.cluster(spark.createDataFrame([(1, [1 << 30, 2])], "vec_id long, v array<long>"), size=2)


def test_vectors_that_are_kept(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (6, [1.0]), (7, None), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.999])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("own"))
    got = {r.vec_id: r.v for r in balls.scaled_vectors(df, size=2).collect()}
    assert got == {1: [128, -1], None: [256, 255]}
