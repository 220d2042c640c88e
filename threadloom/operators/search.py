"""Text search: phrases as substrings, BM25 over all documents, best hits, and a trigram index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import contains_ascii_folded, contains_folded
from threadloom.operators.snapshots import latest_by

#: Constants of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def matches(text: Column, phrase: str) -> Column:
    """Phrases of three characters or more without regard to case in any script, shorter ones with ASCII case folded."""
    return contains_folded(text, phrase) if len(phrase) >= 3 else contains_ascii_folded(text, phrase)


def trigrams(text: Column) -> Column:
    """The overlapping three-character substrings of the lower-cased text, whose characters are split once."""
    joined = lambda x, y: F.concat(x, y)
    of = lambda c: F.zip_with(F.zip_with(c, F.slice(c, 2, F.size(c)), joined), F.slice(c, 3, F.size(c)), joined)
    return F.filter(F.transform(F.array(F.split(F.lower(text), "")), of)[0], lambda g: g.isNotNull())


def trigram_postings(docs: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """trigram, n_docs, n_occurrences: an inverted index's dictionary. Each row of docs is a document, named by id_cols.

    A text is split into characters once, and its trigrams are sorted in its row, where the first of equal ones counts for
    the document. What is shuffled are sums by trigram only."""
    joined = lambda x, y: F.concat(x, y)
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once
    grams = bound(F.split(F.lower(F.col(text_col)), ""), lambda c: F.zip_with(F.zip_with(c, F.slice(c, 2, F.size(c)), joined), F.slice(c, 3, F.size(c)), joined))
    first = lambda s: F.transform(s, lambda g, i: F.struct(g.alias("trigram"), F.when((i > 0) & (F.get(s, i - 1) == g), 0).otherwise(1).alias("new")))
    marked = bound(F.array_sort(F.filter(grams, lambda g: g.isNotNull())), first)
    each = docs.where(F.length(text_col) >= 3).select(F.explode(marked).alias("g"))
    return each.groupBy(F.col("g.trigram").alias("trigram")).agg(F.sum("g.new").alias("n_docs"), F.count("*").alias("n_occurrences"))


def occurrences(text: Column, phrase: str) -> Column:
    """How often phrase occurs in the lower-cased text; occurrences may overlap, so that each is an empty match before it."""
    return F.regexp_count(F.lower(text), F.lit(f"(?=\\Q{phrase.lower()}\\E)"))


def bm25(docs: DataFrame, phrase: str, *, text_col: str = "text", score: str = "score") -> DataFrame:
    """The documents that hold phrase (three characters or more) with their score; more negative is better.

    A document is as long as it has trigrams. The statistics are over all documents: one row, joined by broadcast."""
    length = F.greatest(F.length(text_col) - 2, F.lit(0)).cast("double")
    hit = contains_folded(F.col(text_col), phrase)
    stats = docs.agg(F.count("*").cast("double").alias("__n"), F.avg(length).alias("__mean"), F.count_if(hit).cast("double").alias("__df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5)))
    tf = F.col("__tf").cast("double")
    value = -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("__mean")))
    found = docs.where(hit).withColumn("__tf", occurrences(F.col(text_col), phrase)).join(F.broadcast(stats))
    return found.withColumn(score, value).drop("__tf", "__n", "__mean", "__df")


def best_hits(hits: DataFrame, group: str, order: list[Column], per_group: int = 1) -> DataFrame:
    return latest_by(hits, [group], order, per_group)


def search_threads(messages: DataFrame, phrase: str, *, group: str, text_col: str, order_col: str, title_col: str | None = None, title_score: float | None = None) -> DataFrame:
    """One hit for each group: the best body hit by score and order; groups whose title alone matches come behind."""
    scored = bm25(messages, phrase, text_col=text_col) if len(phrase) >= 3 else messages.where(matches(F.col(text_col), phrase)).withColumn("score", F.lit(0.0))
    best = best_hits(scored, group, [F.col("score").asc(), F.col(order_col).asc()])
    if title_col is None:
        return best
    behind = title_score if title_score is not None else (1_000_000.0 if len(phrase) >= 3 else 1.0)
    titled = latest_by(messages.where(matches(F.col(title_col), phrase)), [group], [F.col(order_col).asc()]).withColumn("score", F.lit(behind))
    return best.unionByName(titled.join(best.select(group), group, "left_anti"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, maximum: int = 500) -> DataFrame:
    """One page in a fixed order with the total beside each row; limit and offset are checked."""
    if not 1 <= limit <= maximum or offset < 0:
        raise ValueError(f"limit must be 1 to {maximum} and offset 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def next_offset(limit: int, offset: int, total: int) -> int | None:
    return offset + limit if offset + limit < total else None


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def group_threads(messages: DataFrame, query: str = "", *, thread: str, title_col: str | None = None, text_col: str = "text", time_col: str) -> DataFrame:
    """thread, create_time, update_time, messages, preview: all threads, or those whose title or a message holds query as it
    is written (ASCII case apart); preview is the newest text that isn't blank."""
    query = query.strip()
    if len(query) > 512:
        raise ValueError("search query is too long")
    shown = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0
    hit = contains_ascii_folded(F.coalesce(F.col(text_col), F.lit("")), query) if query else F.lit(True)
    if query and title_col:
        hit = hit | contains_ascii_folded(F.coalesce(F.col(title_col), F.lit("")), query)
    latest = F.when(shown, F.col(time_col))
    out = messages.groupBy(thread).agg(F.min(time_col).alias("create_time"), F.max(time_col).alias("update_time"), F.count("*").alias("messages"), F.coalesce(F.max_by(text_col, latest), F.lit("")).alias("preview"), F.bool_or(hit).alias("hit"))
    return out.where("hit").drop("hit")
