"""Vector retrieval: chunks, similarity, top-k and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def chunks(docs: DataFrame, *, text_col: str = "text", size: int = 600, overlap: int = 100) -> DataFrame:
    """docs with chunk_offset and chunk: windows of size code points every size - overlap, until the tail is covered."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - overlap - 1, F.lit(0)), F.lit(step))
    out = docs.where(F.length(text_col) > 0).withColumn("chunk_offset", F.explode(starts))
    return out.withColumn("chunk", F.substring(F.col(text_col), F.col("chunk_offset") + 1, F.lit(size)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_similar(vectors: DataFrame, query: DataFrame, *, id_col: str, vector_col: str, k: int = 40) -> DataFrame:
    """The k vectors most like the one query row, with similarity; equal ones in order of id. The query is broadcast: it is
    one row."""
    one = F.broadcast(query.select(F.col(vector_col).alias("__query")).limit(1))
    scored = vectors.join(one).withColumn("similarity", cosine(F.col(vector_col), F.col("__query"))).drop("__query")
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def fuse_ranks(rows: DataFrame, first: list[Column], second: list[Column], *, group: list[str] | None = None) -> DataFrame:
    """rows with rank_first, rank_second and fused, the sum of 1 / (60 + rank) over both orders. rows are candidates of one
    search, or of each group."""
    one, two = Window.partitionBy(*(group or [])).orderBy(*first), Window.partitionBy(*(group or [])).orderBy(*second)
    ranked = rows.withColumn("rank_first", F.row_number().over(one).cast("long")).withColumn("rank_second", F.row_number().over(two).cast("long"))
    return ranked.withColumn("fused", 1.0 / (RANK_CONSTANT + F.col("rank_first")) + 1.0 / (RANK_CONSTANT + F.col("rank_second")))


def index_changes(index: DataFrame, live: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of live that the index lacks, rows of the index that aren't live)."""
    return live.join(index.select(*keys), keys, "left_anti"), index.join(live.select(*keys), keys, "left_anti")


def search(chunks_: DataFrame, query: DataFrame, *, thread: str, id_col: str, vector_col: str, excluded: DataFrame | None = None, rerank: str | None = None, limit: int = 8, k: int = 40) -> DataFrame:
    """The best chunk of each of `limit` threads: of the k chunks most like the query's vector, in that order or, with a
    column of scores to rerank by, in the order of both ranks fused. Excluded messages are no candidates."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    live = chunks_ if excluded is None else chunks_.join(excluded.select(id_col), id_col, "left_anti")
    best = top_similar(live, query, id_col=id_col, vector_col=vector_col, k=k)
    order = [F.desc("similarity"), F.asc(id_col)]
    if rerank:
        best = fuse_ranks(best, order, [F.desc(rerank), F.asc(id_col)])
        order = [F.desc("fused"), *order]
    one = best.withColumn("n", F.row_number().over(Window.partitionBy(thread).orderBy(*order))).where("n = 1").drop("n")
    return one.orderBy(*order).limit(limit)
