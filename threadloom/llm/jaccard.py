"""Exact n-gram Jaccard join by pivots (operator 5).

The Jaccard distance is a metric, but unrelated texts all lie at a distance of 1 from each other and from every pivot, so
that pivots alone can't part them. The join therefore has two levels:

1. Regions. Equal sets become one class. Two linked sets differ in at most D elements, D following from the threshold and
   their sizes; cut into D + 1 parts or more by the value of their hashes, they have one part at least in common. The
   class with the least hash among those that share a part is a pivot, and every class of that part goes to its region.
   Any two linked classes meet in a region, without exception.
   Counts of a set's elements in COUNTS ranges of their hashes are an embedding that doesn't lengthen distances: linked sets
   differ in no more counts than in elements. Members of a region that no chain of such near neighbours joins part before
   any text is read; each chain becomes a region, named by its least class, so that the same chain from several regions is
   one.
2. In a region, distances to a few pivots (linear work) link members to pivots; members whose distances to some pivot
   differ by more than the radius, or that are connected already, need no comparison; all others are compared exactly.
   A region with more than `region_rows` members is first split: its members go to the Voronoi cell of their nearest pivot
   and, by the triangle inequality, as boundary members to each cell that is at most twice the radius farther away; cells
   split again until they are small. A region whose cells would take as long to compare as itself (members that lie closer
   together than the radius, or all as far from each other) isn't split: it is compared chunk against chunk, each pair of
   chunks a task of bounded size.

Sets are of 64-bit hashes of shingles. Texts, never prefixes, are read for the regions' members only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import hashing as H
from threadloom.llm.components import components, filter_of, passes
from threadloom.llm.shared import checked_broadcast, shared_table, text_or_empty

U = np.uint64
REGION_ROWS = 4096
BROADCAST_ROWS = 400_000
PIVOTS = 8
SPLIT_PIVOTS = 48
ELEMENTS = 500
COUNTS = 128
#: A region is split if its cells have this share of its pairs at most.
LEAST_PROGRESS = 0.7
#: Members and elements in one product of sets' tables, and pairs of equal elements that are listed at once.
BLOCK_ROWS, BLOCK_ELEMENTS, BLOCK_PAIRS = 256, 2048, 1 << 21


def band_edges(largest: int, num: int, den: int) -> list[int]:
    """Lower ends of bands of set sizes; a set and any linked larger one are in one band or in neighbours."""
    edges = [1, 2]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    return edges


def parts_of(band: int, edges: list[int], num: int, den: int) -> tuple[int, int]:
    """(parts, spare) for pairs whose smaller set is in this band; 0 parts if they can only be equal.

    Linked sets have spare + 1 equal parts at least."""
    small = edges[band + 1] - 1
    most = (small + small * den // num) * (den - num) // (den + num)
    spare = 1 + most // 12 if most >= 3 else 0
    return (most + 1 + spare, spare) if most else (0, 0)


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, sorted distinct shingle hashes of a run of texts, where each text's begin)."""
    for first, data, offsets in H.blocks(texts):
        hashes, _, _, begins = H.words(data, offsets)
        found, begins = H.shingles(hashes, begins, k)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[begins[:-1][begins[:-1] < len(found)]] = True
        yield first, found[new], np.concatenate([[0], np.cumsum(new)])[begins]


def set_hash(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One hash for each set; that of the empty set is a fixed value."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(H.mix(elements ^ U(0x5851F42D4C957F2D)))])
    n = np.diff(begins).astype(U)
    return H.mix(total[begins[1:]] - total[begins[:-1]] + n * U(0x9E3779B97F4A7C15))


def part_keys(elements: np.ndarray, begins: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, key) for all parts of all sets that may have to meet another's."""
    sizes = np.diff(begins)
    edges = band_edges(int(sizes.max(initial=1)), num, den)
    band = np.searchsorted(edges, sizes, "right") - 1
    plan = np.array([parts_of(b, edges, num, den) for b in range(len(edges) - 1)], np.int64).reshape(-1, 2)
    mixed, owner = H.mix(elements), np.repeat(np.arange(len(sizes)), sizes)
    who, keys = [], []
    for back in (0, 1):
        joined = band - back
        ok = (sizes > 0) & (joined >= 0)
        m = np.where(ok, plan[np.maximum(joined, 0), 0], 0)
        spare = plan[np.maximum(joined, 0), 1]
        mine = m[owner] > 0
        if not mine.any():
            continue
        own, e = owner[mine], elements[mine]
        part = ((e >> U(32)) * m[own].astype(U)) >> U(32)
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])]))
        salt = H.mix((joined[own[new]].astype(U) << U(32)) + part[new] + U(1))
        who.append(own[new])
        keys.append(H.mix(np.add.reduceat(mixed[mine], new) ^ salt))
        filled = np.bincount(own[new], minlength=len(sizes))
        for i in np.flatnonzero((m > 0) & (m - filled > spare)):
            absent = np.setdiff1d(np.arange(m[i], dtype=U), part[new][own[new] == i])
            who.append(np.full(len(absent), i))
            keys.append(H.mix(H.mix((U(joined[i]) << U(32)) + absent + U(1))))
    return (np.concatenate(who), np.concatenate(keys)) if who else (np.zeros(0, np.int64), np.zeros(0, U))


class Region:
    """The sets of some members, with intersections of one or some with all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mark = np.zeros(int(self.ids.max(initial=0)) + 1, bool)
        self.often = None

    def common(self, i: int) -> np.ndarray:
        """Sizes of the intersections of set i with all sets."""
        own = self.ids[self.begins[i] : self.begins[i + 1]]
        self.mark[own] = True
        out = np.bincount(self.owner[self.mark[self.ids]], minlength=len(self.sizes))
        self.mark[own] = False
        return out

    def _prepare(self) -> None:
        """Elements that many sets have are columns of a table; of others that are in two sets or more, these are listed."""
        m = len(self.sizes)
        n = np.bincount(self.ids)
        often = n > max(1, m // 16)
        column = np.cumsum(often) - 1
        self.often = np.zeros((m, int(often.sum())), np.uint8)
        at = often[self.ids]
        self.often[self.owner[at], column[self.ids[at]]] = 1
        at = np.flatnonzero(~at & (n[self.ids] > 1))
        self.few, self.few_begins = self.ids[at], np.searchsorted(self.owner[at], np.arange(m + 1))
        order = np.argsort(self.few, kind="stable")
        self.few_owner, self.element_begins = self.owner[at][order], np.concatenate([[0], np.cumsum(np.bincount(self.few, minlength=len(n)))])
        self.few_pairs = np.concatenate([[0], np.cumsum(np.diff(self.element_begins)[self.few])])

    def commons(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets `rows` with other sets, `columns` (of a set with itself, only what others have too)."""
        if self.often is None:
            self._prepare()
        m = len(self.sizes)
        product = np.zeros((len(rows), len(columns)), np.float32)
        for a in range(0, self.often.shape[1], BLOCK_ELEMENTS):
            own = self.often[rows, a : a + BLOCK_ELEMENTS].astype(np.float32)
            product += own @ self.often[columns, a : a + BLOCK_ELEMENTS].astype(np.float32).T
        out = product.astype(np.int64)
        pairs = self.few_pairs[self.few_begins[rows + 1]] - self.few_pairs[self.few_begins[rows]]
        total, a = np.cumsum(pairs), 0
        while a < len(rows):  # so many pairs at a time, or those of one set
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_PAIRS, "right")))
            low, high = self.few_begins[rows[a:b]], self.few_begins[rows[a:b] + 1]
            element = self.few[_ranges(low, high)]
            begin, end = self.element_begins[element], self.element_begins[element + 1]
            if len(element):
                row = np.repeat(np.repeat(np.arange(b - a), high - low), end - begin)
                found = np.bincount(row * m + self.few_owner[_ranges(begin, end)], minlength=(b - a) * m)
                out[a:b] += found.reshape(b - a, m)[:, columns]
            a = b
        return out


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers from each of begins to before its end."""
    n = ends - begins
    return np.arange(n.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)


class Labels:
    """A label for each of m members, equal for those that are joined."""

    def __init__(self, m: int):
        self.label = np.arange(m)

    def join(self, i: int, others: np.ndarray) -> None:
        if len(others):
            old = np.unique(np.append(self.label[others], self.label[i]))
            if len(old) > 1:
                self.label[np.isin(self.label, old)] = old[0]

    def undecided(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, others): blocks of members that are compared with others, so that every pair that isn't joined is asked.

        One of such a pair at least isn't joined to the largest group; what joins that meanwhile isn't asked for itself."""
        label, done = self.label, np.zeros(len(self.label), bool)
        names, first, n = np.unique(label, return_index=True, return_counts=True)
        most = first[np.argmax(n)]
        for i in range(0, len(rest := np.flatnonzero(label != label[most])), size):
            rows = rest[i : i + size]
            rows = rows[label[rows] != label[most]]
            if len(rows):
                yield rows, np.flatnonzero(~done)
                done[rows] = True


def connect(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal for sets that links connect. side: links of sets of one side needn't all be found."""
    m = len(sets)
    labels = Labels(m)
    if m < 2:
        return labels.label
    region = Region(sets)
    sizes, radius = region.sizes, 1 - num / den + 1e-9
    far = []
    for p in np.unique(np.linspace(0, m - 1, min(m, PIVOTS)).astype(int)):
        both = region.common(p)
        either = sizes + sizes[p] - both
        far.append(1 - both / np.maximum(either, 1))
        labels.join(p, np.flatnonzero(den * both >= num * either))
    far = np.array(far)
    for rows, others in labels.undecided(BLOCK_ROWS):
        own, n = sizes[rows][:, None], sizes[others][None, :]
        ok = (labels.label[rows][:, None] != labels.label[others][None, :]) & (num * np.maximum(n, own) <= den * np.minimum(n, own))
        for x in far:
            ok &= np.abs(x[rows][:, None] - x[others][None, :]) <= radius
        if side is not None:
            ok &= side[rows][:, None] != side[others][None, :]
        some, asked = ok.any(axis=1), ok.any(axis=0)
        if not some.any():
            continue
        rows, others, ok = rows[some], others[asked], ok[some][:, asked]
        both = region.commons(rows, others)
        ok &= den * both >= num * (sizes[rows][:, None] + sizes[others][None, :] - both)
        for i in np.flatnonzero(ok.any(axis=1)):
            labels.join(rows[i], others[ok[i]])
    return labels.label


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one key, across batches; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a < b and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _members(group: pa.Table, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct classes of a group, their sets, and their rows. Rows whose text isn't their class's are left out."""
    classes = group["cls"].to_numpy().view(U)
    ids, sets, rows, seen = [], [], [], set()
    for first, elements, begins in sets_of(group["text"].combine_chunks(), k):
        for i, h in enumerate(set_hash(elements, begins)):
            if h == classes[first + i] and h not in seen:
                seen.add(h)
                ids.append(h)
                sets.append(elements[begins[i] : begins[i + 1]])
                rows.append(first + i)
    order = np.argsort(np.array(ids, U), kind="stable")
    return np.array(ids, U)[order], [sets[i] for i in order], np.array(rows, np.int64)[order]


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    root = ids[label]
    own = root != ids
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(root[own])], ["a", "b"])


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, region_rows: int = REGION_ROWS, split_pivots: int = SPLIT_PIVOTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id_col, n_shingles (long), component_id: one row for each row of docs.

    Sets of word shingles (A-Z lower-cased; a text with fewer words is one shingle) are linked when 100 * intersection >=
    percent * union. component_id is the least id that links reach, the row's own included. A text without words, or
    null, is linked with nothing; so is a row with a null id, whose component is null. Rows that repeat come back each."""
    num, den = percent, 100
    data = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def classes(batches):
        for batch in batches:
            n, h, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U), []
            for first, elements, begins in sets_of(batch.column(1), words):
                n[first : first + len(begins) - 1], h[first : first + len(begins) - 1] = np.diff(begins), set_hash(elements, begins)
                counts += [c.tobytes() for c in counts_of(elements, begins)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(H.signed(h)), pa.array(counts, pa.binary())], ["id", "n", "cls", "counts"])

    rows = shared_table(data.mapInArrow(classes, "id long, n long, cls long, counts binary"), "jaccard-sets")

    def keyed(bits=None):
        def make(batches):
            for batch in batches:
                for _, elements, begins in sets_of(batch.column(1), words):
                    who, keys = part_keys(elements, begins, num, den)
                    if bits is not None:
                        ok = passes(bits.value, keys)
                        who, keys = who[ok], keys[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(H.signed(keys)), pa.array(H.signed(set_hash(elements, begins)[who]))], ["key", "cls"])

        return data.where(F.col("id").isNotNull()).mapInArrow(make, "key long, cls long")

    shared = shared_table(keyed().groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last")).where("pivot <> last").select("key", "pivot"), "jaccard-parts")
    bits = data.sparkSession.sparkContext.broadcast(filter_of(shared))
    regions = keyed(bits).join(shared, "key").select("pivot", "cls").distinct()
    first = shared_table(rows.where(F.col("id").isNotNull()).groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n")), "jaccard-classes")
    regions = _narrowed(shared_table(regions.join(first, "cls"), "jaccard-regions"), rows, num, den, region_rows)
    edges = _solve(data, regions, words, num, den, region_rows, split_pivots, broadcast_rows)
    # Classes go by their least id, so that the least one that links reach is the component; each joins its own rows only.
    own = first.where("n > 0").select(F.col("cls").alias("of"), "id").join(components(edges), F.col("id") == F.col("node"), "left")
    own = shared_table(own.select("of", F.coalesce("component", "id").alias("least")), "jaccard-least")
    own = F.broadcast(own) if own.count() <= broadcast_rows else own
    out = rows.join(own, rows["cls"] == own["of"], "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(linked, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """docs without the texts that links connect with a smaller id: one document of each component stays.

    Rows with one id count as one document; of rows that repeat id and text, one stays. Texts without words and rows with
    a null id all stay. Which ids go is written down, counted, and joined by a broadcast or, if they are many, a shuffle."""
    found = shared_table(jaccard_components(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **options), "jaccard-components")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, id_col, "left_anti").select(*docs.columns)
    again = shared_table(found.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "jaccard-repeated-ids")
    if again.isEmpty():
        return left
    twice = left.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col])
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(twice)


def _with_text(data: DataFrame, regions: DataFrame, broadcast_rows: int) -> DataFrame:
    """regions (with id) and their members' texts: by a broadcast up to broadcast_rows, else by a shuffle of the texts."""
    side = F.broadcast(regions) if regions.count() <= broadcast_rows else regions
    return data.join(side, "id")


def _sized(regions: DataFrame) -> DataFrame:
    """regions with size: members, or more if their sets are larger than ELEMENTS on average."""
    size = F.greatest(F.count("*"), F.ceil(F.sum("n") / ELEMENTS))
    sizes = shared_table(regions.groupBy("pivot").agg(size.alias("size")), "jaccard-sizes")
    return regions.join(checked_broadcast(sizes, BROADCAST_ROWS), "pivot")


def counts_of(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of COUNTS bytes for each set: elements in each range of hashes, 255 at most."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = owner * COUNTS + (elements >> U(64 - COUNTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=(len(begins) - 1) * COUNTS), 255).astype(np.uint8).reshape(-1, COUNTS)


def chains(counts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A label for each set, equal for sets that a chain of possible links joins."""
    m = len(sizes)
    labels, wide = Labels(m), counts.astype(np.int16)

    def join(rows: np.ndarray, others: np.ndarray) -> None:
        n, own = sizes[others][None, :], sizes[rows][:, None]
        apart = np.abs(wide[rows][:, None, :] - wide[others][None, :, :]).sum(axis=2, dtype=np.int64)
        ok = (apart * (den + num) <= (n + own) * (den - num)) & (num * np.maximum(n, own) <= den * np.minimum(n, own))
        for i, row in zip(rows, ok, strict=True):
            labels.join(i, others[row])

    join(np.unique(np.linspace(0, m - 1, min(m, PIVOTS)).astype(int)), np.arange(m))
    for rows, others in labels.undecided(16):
        join(rows, others)
    return labels.label


def _narrowed(regions: DataFrame, rows: DataFrame, num: int, den: int, region_rows: int) -> DataFrame:
    """Regions (pivot, cls, id, n) by chains of possible links; those over region_rows stay as they are."""
    sized = _sized(regions)

    def part(batches):
        for group in _groups(batches, "pivot"):
            classes, first = np.unique(group["cls"].to_numpy(), return_index=True)
            if len(classes) < 2:
                continue
            own = group.take(pa.array(first))
            counts = np.frombuffer(b"".join(own["counts"].to_pylist()), np.uint8).reshape(-1, COUNTS)
            label = chains(counts, own["n"].to_numpy(), num, den)
            keep = np.bincount(label, minlength=len(label))[label] > 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(classes[label][keep]), pa.array(classes[keep]), pa.array(own["id"].to_numpy()[keep]), pa.array(own["n"].to_numpy()[keep])], ["pivot", "cls", "id", "n"])

    small = sized.where(F.col("size") <= region_rows).select("pivot", "cls", "id", "n").join(rows.select("id", "cls", "counts"), ["id", "cls"])
    out = small.select("pivot", "cls", "id", "n", "counts").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(part, "pivot long, cls long, id long, n long").distinct()
    return shared_table(out.unionByName(sized.where(F.col("size") > region_rows).select("pivot", "cls", "id", "n")), "jaccard-narrowed")


def _solve(data: DataFrame, regions: DataFrame, words: int, num: int, den: int, region_rows: int, split_pivots: int, broadcast_rows: int) -> DataFrame:
    """Edges (a, b) between the least ids of classes that connect what links connect, from regions (pivot, cls, id, n)."""

    def small(batches):
        for group in _groups(batches, "pivot"):
            _, sets, at = _members(group, words)
            if len(at) > 1:
                yield _edges(group["id"].to_numpy()[at], connect(sets, num, den))

    found = []
    if regions.count() > broadcast_rows:  # their members' texts are shuffled again and again, others only here
        data = shared_table(data.join(checked_broadcast(shared_table(regions.select("id").distinct(), "jaccard-members"), broadcast_rows), "id", "left_semi"), "jaccard-texts")
    while True:
        sized = _sized(regions)
        near = _with_text(data, sized.where(F.col("size") <= region_rows).drop("size"), broadcast_rows)
        found.append(shared_table(near.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(small, "a long, b long"), "jaccard-edges"))
        large = sized.where(F.col("size") > region_rows)
        if large.isEmpty():
            break
        more, cells = _split(data, large, words, num, den, region_rows, split_pivots, broadcast_rows)
        found.append(more)
        apart = shared_table(_worth_splitting(large, cells), "jaccard-apart")
        whole = large.join(checked_broadcast(apart, BROADCAST_ROWS), large["pivot"] == apart["region"], "left_anti")
        found.append(_chunks(data, whole, words, num, den, region_rows, broadcast_rows))
        regions = cells.join(checked_broadcast(apart, BROADCAST_ROWS), "region").select("pivot", "cls", "id", "n").distinct()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _split(data: DataFrame, large: DataFrame, words: int, num: int, den: int, region_rows: int, split_pivots: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges to pivots, and the Voronoi cells with their boundary members (region, pivot, cls, id, n).

    A cell's name hashes the region's and the pivot's. Each task has a chunk of region_rows members and all pivots."""
    pivots = _least(large, split_pivots)
    chunk = F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("size") / region_rows))
    members = large.withColumn("chunk", chunk).withColumn("is_pivot", F.lit(False))
    spread = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / region_rows) - 1))).withColumn("is_pivot", F.lit(True))
    cols = ["pivot", "cls", "id", "n", "chunk", "is_pivot"]
    task = shared_table(members.select(*cols).unionByName(spread.select(*cols)).withColumn("task", F.xxhash64("pivot", "chunk")), "jaccard-split")
    radius = 1 - num / den + 1e-9

    def cells(batches):
        for group in _groups(batches, "task"):
            for region in np.unique(group["pivot"].to_numpy()):
                own = group.filter(pa.compute.equal(group["pivot"], int(region)))
                pids, psets, pivots_at = _members(own.filter(own["is_pivot"]), words)
                pivot_docs = own.filter(own["is_pivot"])["id"].to_numpy()[pivots_at]
                ids, sets, at = _members(own.filter(pa.compute.invert(own["is_pivot"])), words)
                docs, n = (own.filter(pa.compute.invert(own["is_pivot"]))[c].to_numpy()[at] for c in ("id", "n"))
                all_sets = Region(psets + sets)
                both = np.array([all_sets.common(p) for p in range(len(pids))])[:, len(pids) :]
                sizes = all_sets.sizes
                either = sizes[: len(pids), None] + sizes[None, len(pids) :] - both
                far = 1 - both / np.maximum(either, 1)
                p, m = np.nonzero((far - far.min(axis=0) <= 2 * radius) & (far < 1))
                name = H.mix(pids[p] ^ H.mix(np.full(len(p), region).view(U)))
                linked = den * both[p, m] >= num * either[p, m]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), region)), pa.array(H.signed(name)), pa.array(H.signed(ids[m])), pa.array(docs[m]), pa.array(n[m]), pa.array(pivot_docs[p]), pa.array(linked)], ["region", "pivot", "cls", "id", "n", "a", "linked"])
                lone = np.flatnonzero(far.min(axis=0) >= 1 - 2 * radius)  # may lie outside all pivots' reach: one more cell
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lone), region)), pa.array(np.full(len(lone), H.signed(H.mix(np.array([region]).view(U)))[0])), pa.array(H.signed(ids[lone])), pa.array(docs[lone]), pa.array(n[lone]), pa.array(docs[lone]), pa.array(np.zeros(len(lone), bool))], ["region", "pivot", "cls", "id", "n", "a", "linked"])

    out = shared_table(_with_text(data, task, broadcast_rows).repartition("task").sortWithinPartitions("task").mapInArrow(cells, "region long, pivot long, cls long, id long, n long, a long, linked boolean"), "jaccard-cells")
    return out.where("linked").select("a", F.col("id").alias("b")), out.select("region", "pivot", "cls", "id", "n")


def _worth_splitting(large: DataFrame, cells: DataFrame) -> DataFrame:
    """The regions (region) whose cells together have LEAST_PROGRESS of the region's pairs at most."""
    size = F.greatest(F.count("*"), F.ceil(F.sum("n") / ELEMENTS)).cast("double")
    after = cells.groupBy("region", "pivot").agg(size.alias("size")).groupBy("region").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    before = large.groupBy("pivot").agg(F.first("size").cast("double").alias("size"))
    return before.join(after, F.col("region") == F.col("pivot")).where(F.col("pairs") <= F.lit(LEAST_PROGRESS) * F.col("size") * F.col("size")).select("region")


def _least(large: DataFrame, count: int) -> DataFrame:
    """The rows of each region with the least hashes; a window that keeps `count` rows a group before it shuffles."""
    order = Window.partitionBy("pivot").orderBy(F.xxhash64("cls", "pivot"), "cls")
    return large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).drop("rank")


def _chunks(data: DataFrame, large: DataFrame, words: int, num: int, den: int, region_rows: int, broadcast_rows: int) -> DataFrame:
    """Edges of regions that cells don't part: every pair of chunks is a task, and each chunk with itself."""
    half = max(1, region_rows // 2)
    n = F.ceil(F.col("size") / half)
    own = large.withColumn("n", n).withColumn("c", F.pmod(F.xxhash64("cls", F.lit(2)), n))
    pairs = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("pivot", "cls", "id", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), (F.col("c") < F.col("o")).alias("left"))
    task = shared_table(pairs.withColumn("task", F.xxhash64("pivot", "x", "y")), "jaccard-chunks")

    def compare(batches):
        for group in _groups(batches, "task"):
            _, sets, at = _members(group, words)
            if len(at) > 1:
                left = group["left"].to_numpy()[at]
                yield _edges(group["id"].to_numpy()[at], connect(sets, num, den, left if left.any() and not left.all() else None))

    return shared_table(_with_text(data, task.select("task", "cls", "id", "left"), broadcast_rows).repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long"), "jaccard-chunk-edges")
