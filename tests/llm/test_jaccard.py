import random
import re

import numpy as np
import pytest

from threadloom.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(fold(t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def corpus(seed=3, families=8, copies=14):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(families):
        base = r.choices(words, k=r.choice([1, 2, 3, 8, 30, 60, 150, 400]))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + 0, None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t"), (len(rows) + 3, "W1 w2"), (len(rows) + 4, "w1\nW2")]
    return rows


@pytest.mark.parametrize(("k", "percent", "region_rows"), [(3, 90, 4096), (5, 80, 4096), (3, 90, 8)])
def test_components_equal_brute_force(spark, k, percent, region_rows):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, words=k, percent=percent, region_rows=region_rows, split_pivots=2).collect()}
    assert got == brute(rows, k, percent)


def test_shuffled_texts_give_the_same(spark):
    rows = corpus(seed=5, families=5, copies=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, words=3, percent=90, broadcast_rows=0).collect()}
    assert got == {k: v[1] for k, v in brute(rows, 3, 90).items()}


def test_null_ids_repeats_and_empty_table(spark):
    text = " ".join("abcdefgh")
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, "other words here now", "x")], "doc_id long, text string, component string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 2)]
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []


def test_enough_parts_are_equal():
    for num in (80, 90):
        edges = jaccard.band_edges(3000, num, 100)
        for small in range(1, 2000, 7):
            band = max(i for i, e in enumerate(edges) if e <= small)
            large = small * 100 // num
            upper = max(i for i, e in enumerate(edges) if e <= large)
            assert upper - band <= 1
            m, spare = jaccard.parts_of(band, edges, num, 100)
            differing = (small + large) * (100 - num) // (100 + num)
            assert m == 0 and differing == 0 or m - differing > spare


def test_counts_never_part_linked_sets():
    r = np.random.Generator(np.random.PCG64(5))
    base = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2))
    near = np.unique(np.concatenate([base[: int(len(base) * 0.9)], r.integers(0, 2**63, 90, dtype=np.uint64) * np.uint64(2)]))
    other = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2))
    sets = [base, near, other]
    assert len(np.intersect1d(base, near)) >= 0.8 * len(np.union1d(base, near))
    counts = jaccard.counts_of(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert counts.sum() == sum(map(len, sets))
    label = jaccard.chains(counts, np.array([len(s) for s in sets]), 80, 100)
    assert label[0] == label[1] != label[2]


def test_a_region_that_cells_do_not_part_is_compared_itself(spark, monkeypatch):
    """Changed copies of one text, as far from each other as from any pivot: each lies in most cells."""
    r = random.Random(11)
    words = ["w%d" % i for i in range(5000)]
    base, rows, chunked = r.choices(words, k=200), [], []
    for i in range(64):
        w = list(base)
        for _ in range(2 if i % 4 == 0 else 9):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    write = jaccard.shared_table

    def counted(df, name):
        out = write(df, name)
        if name == "jaccard-chunks":
            chunked.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "shared_table", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(docs, words=5, percent=80, region_rows=16, split_pivots=8)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()}
    assert got == brute(rows, 5, 80)
    # each of a region's members is in as many pairs of chunks as there are chunks of 8; members share a few regions
    assert 0 < sum(chunked) <= 10 * 64 * 8


def test_links_of_many_sets_at_once_equal_those_of_pairs(monkeypatch):
    """Elements that many sets have, that a few have, and that one has; blocks of any size, and links across two sides."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 16)
    monkeypatch.setattr(jaccard, "BLOCK_PAIRS", 50)
    r = random.Random(2)
    for n in (2, 40, 150):
        sets = []
        for i in range(n):
            own = set(range(i % 3 * 100, i % 3 * 100 + 60)) | {1000 + (i // 5) * 20 + j for j in range(r.randint(0, 20))}
            sets.append(np.array(sorted(x for x in own | {10**6 + i} if r.random() > 0.04), np.uint64))
        want, up = np.zeros((n, n), int), list(range(n))
        for i in range(n):
            for j in range(n):
                want[i, j] = len(np.intersect1d(sets[i], sets[j]))
        rows, columns = np.arange(0, n, 2), np.arange(n // 3, n)
        other = rows[:, None] != columns[None, :]
        assert (jaccard.Region(sets).commons(rows, columns) == want[np.ix_(rows, columns)])[other].all()
        side = np.arange(n) % 2 == 0

        def label(asked, up=up, want=want, sets=sets, n=n):
            up = list(up)
            for i in range(n):
                for j in range(i):
                    if asked(i, j) and 100 * want[i, j] >= 85 * (len(sets[i]) + len(sets[j]) - want[i, j]):
                        a, b = sorted((up[i], up[j]))
                        up = [a if x == b else x for x in up]
            return up

        every = jaccard.connect(sets, 85, 100)
        assert {tuple(np.flatnonzero(every == x)) for x in every} == {tuple(np.flatnonzero(np.array(label(lambda i, j: True)) == x)) for x in label(lambda i, j: True)}
        across = jaccard.connect(sets, 85, 100, side)
        least = np.array(label(lambda i, j, side=side: side[i] != side[j]))
        assert all(len({int(every[i]) for i in np.flatnonzero(across == x)}) == 1 for x in across)  # nothing that isn't linked
        assert all(len({int(across[i]) for i in np.flatnonzero(least == x)}) == 1 for x in least)  # all that links across join


def test_chains_equal_those_of_all_pairs():
    r = np.random.default_rng(4)
    kinds = r.integers(0, 6, (5, jaccard.COUNTS))
    counts = np.stack([np.maximum(0, kinds[i % 5] + (r.random(jaccard.COUNTS) < 0.06 * (i % 4))) for i in range(90)]).astype(np.uint8)
    sizes = counts.sum(axis=1).astype(np.int64)
    up = list(range(90))
    for i in range(90):
        for j in range(i):
            apart = np.abs(counts[i].astype(int) - counts[j]).sum()
            if apart * 195 <= (sizes[i] + sizes[j]) * 5 and 95 * max(sizes[i], sizes[j]) <= 100 * min(sizes[i], sizes[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    got = jaccard.chains(counts, sizes, 95, 100)
    assert len(set(up)) > 5
    assert {tuple(np.flatnonzero(got == x)) for x in got} == {tuple(np.flatnonzero(np.array(up) == x)) for x in up}


def test_only_members_texts_are_shuffled(spark, monkeypatch):
    """With op5's settings and more members than are broadcast: texts that share no part with others aren't taken along."""
    r = random.Random(8)
    words = ["w%d" % i for i in range(5000)]
    rows = [(i, " ".join(r.choices(words, k=120))) for i in range(60)]
    near = [rows[i % 3][1].split() for i in range(6)]
    for i, w in enumerate(near):
        w[7 * i + 20] = "other"
        rows.append((60 + i, " ".join(w)))
    write, taken = jaccard.shared_table, []

    def counted(df, name):
        out = write(df, name)
        if name == "jaccard-texts":
            taken.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "shared_table", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(docs, words=3, percent=90, broadcast_rows=2)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()} == brute(rows, 3, 90)
    assert len(taken) == 1 and 2 < taken[0] <= 9
