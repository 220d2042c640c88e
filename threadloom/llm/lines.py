"""Quality rules by cross-document line frequency (operator 6) and site-relative line dedup (operator 8).

Both count, for every host, the documents that hold a normalised line; each row is a document. Only functions of Spark SQL
are used.

The lines of a host that exceed a share of its pages number less than (lines a page / share), whatever the host's size,
so that a host's array of such lines is bounded. The table of those arrays has a row for each host that has any; it is
counted, broadcast up to `broadcast_rows`, and joined by a shuffle beyond that.

Nulls: a null text counts as empty, a null host as a host of its own. Rows that repeat count each and get equal results.
An empty table gives no rows. Columns with a result's name give way to it; others are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import SPACE, SPACE_CHARS, checked_broadcast, columns, let, shared_table, text_or_empty, unused, without, word_array, word_count

BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, white space collapsed and trimmed."""
    return F.translate(F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), f"[{SPACE}]+", " "), _UPPER, _LOWER)


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def frequent_lines(docs: DataFrame, *, text_col: str, host_col: str, min_pages: int, max_share: float) -> DataFrame:
    """host, frequent array<bigint>: hashes of the lines in more than max_share of the host's documents, and in min_pages of
    them at least. One row for each host that has such lines.

    Every line of every document is counted, once for each document. Counts are summed before they are shuffled, so a hot
    line or host arrives as one row for each map task."""
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), text_or_empty(text_col).alias("t"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(split_lines(F.col("t")), has_word), line_hash))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.col("pages") * max_share).groupBy("host").agg(F.collect_list("line").alias("frequent"))


def _with_frequent(docs: DataFrame, found: DataFrame, host_col: str, broadcast_rows: int) -> tuple[DataFrame, Column]:
    """docs with the frequent lines of each row's host, and the column that has them."""
    host, frequent = unused(docs, "host"), unused(docs, "frequent")
    side = checked_broadcast(shared_table(found, "frequent-lines"), broadcast_rows).select(F.col("host").alias(host), F.col("frequent").alias(frequent))
    on = F.coalesce(docs[host_col].cast("string"), F.lit("\0")) == side[host]
    return docs.join(side, on, "left"), F.coalesce(frequent, F.array().cast("array<bigint>"))


def drop_frequent_lines(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_pages: int = 10, max_share: float = 0.1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Operator 8. docs with text_col rewritten without the lines that more than max_share of the host's documents hold
    (and min_pages of them at least, as on a host of a few pages any line is on a large share), and with n_lines, n_dropped (long): \\n-split lines with a word, and those dropped.

    A text that loses no line keeps its bytes; a null text stays null with 0 lines."""
    found = frequent_lines(docs, text_col=text_col, host_col=host_col, min_pages=min_pages, max_share=max_share)
    docs = without(docs, "n_lines", "n_dropped")
    both, frequent = _with_frequent(docs, found, host_col, broadcast_rows)
    lines, gone_ = split_lines(text_or_empty(text_col)), unused(both, "gone")
    gone = F.when(F.size(frequent) == 0, F.array().cast("array<string>")).otherwise(F.filter(lines, lambda x: has_word(x) & F.array_contains(frequent, line_hash(x))))
    out = both.withColumn("n_lines", F.size(F.filter(lines, has_word)).cast("long")).withColumn(gone_, gone)
    out = out.withColumn("n_dropped", F.size(gone_).cast("long"))
    keep = F.array_join(F.filter(lines, lambda x: ~(has_word(x) & F.array_contains(frequent, line_hash(x)))), "\n")
    return out.withColumn(text_col, F.when(F.col("n_dropped") == 0, F.col(text_col)).otherwise(keep)).select(*columns(docs), "n_lines", "n_dropped")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more among words (an array), the first one included.

    Windows are compared by a 64-bit hash within one text. Only texts with equal hashes are sorted."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda s, j: F.get(s, j)["h"]
        twice = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (F.when(j > 0, at(s, j - 1)) == x["h"]) | (at(s, j + 1) == x["h"])), lambda x: x["i"])))
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def quality_rules(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_share: float = 0.5, min_pages: int = 20, max_share: float = 0.1, min_left: float = 0.3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Operator 6. docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, words_left
    (long: words outside the host's frequent lines) and kept.

    base_failed: fewer than min_words words, or more than max_repeat_share of them in repeated three-word windows. kept:
    not base_failed, and at least min_left of the words are left once the lines are removed that occur in min_pages
    documents of the host and in more than max_share of them. An empty or null text has no words and fails."""
    found = frequent_lines(docs, text_col=text_col, host_col=host_col, min_pages=min_pages, max_share=max_share)
    docs = without(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")
    both, frequent = _with_frequent(docs, found, host_col, broadcast_rows)
    text, w, gone = text_or_empty(text_col), unused(docs, "words"), unused(docs, "gone")
    lines = F.filter(split_lines(text), has_word)
    out = both.select(
        *columns(docs),
        let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias(w),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size(frequent) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.filter(lines, lambda x: F.array_contains(frequent, line_hash(x))), F.lit(0).cast("long"), lambda a, x: a + word_count(x))).alias(gone),
    )
    out = out.select(*columns(docs), F.col(w)["n"].alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col(w)["r"].alias("n_repeat_words"), (F.col(w)["n"] - F.col(gone)).alias("words_left"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("words_left") >= min_left * F.col("n_words")))
