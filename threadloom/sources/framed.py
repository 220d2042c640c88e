"""Framed text files: every line, or every element of a JSON array, with its number and place, read by as many tasks as there are
splits. Spark's text source cuts files of any size at line ends and names each split; numbers and offsets are sums over splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.validation import ordered_digests


def _pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """file, block, at, value, n_bytes (with the separator), size, modified: at orders the pieces of a block."""
    meta = lambda name: F.col(f"_metadata.{name}")
    read = spark.read.format("text").option("lineSep", separator).load(paths)
    found = read.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), meta("file_size").alias("size"), meta("file_modification_time").alias("modified"), "value")
    return found.withColumns({"at": F.monotonically_increasing_id(), "n_bytes": F.octet_length("value") + F.lit(1).cast("long")})


def _before(value: str, *, by: str = "file") -> Column:
    """The sum of value over the blocks of a file that come before."""
    window = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def framed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ordinal (from 0), offset and n_bytes (of the line and its end), value, line_sha256 (line end included, where there
    is one), size, modified, problem of every line of the files.

    problem: unterminated (the last line has no end), changed (the lines' bytes aren't the file's: it grew or shrank meanwhile),
    blank, not_object (no JSON object, or one with a repeated key); the first of these is named, null if none. Lines end at
    LF alone. Files are read twice, first for the lengths of lines only. Empty files
    have no lines."""
    lines = _pieces(spark, paths, "\n")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    file = Window.partitionBy("file")
    base = blocks.select("file", "block", _before("n").alias("first"), _before("bytes").alias("start"), F.sum("bytes").over(file).alias("total"), F.sum("n").over(file).alias("lines"))
    own = Window.partitionBy("file", "block").orderBy("at")
    sums = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({"nth": F.row_number().over(own) - 1, "ahead": F.coalesce(F.sum("n_bytes").over(sums), F.lit(0))}).join(base, ["file", "block"])
    ordinal = (F.col("first") + F.col("nth")).alias("ordinal")
    placed = placed.select("file", ordinal, (F.col("start") + F.col("ahead")).alias("offset"), "n_bytes", "value", "size", "modified", "total", "lines")
    open_end = (F.col("ordinal") == F.col("lines") - 1) & (F.col("total") == F.col("size") + 1)
    n_bytes = F.col("n_bytes") - open_end.cast("long")
    raw = F.col("value").cast("binary")
    shape = F.schema_of_variant(F.try_parse_json("value"))
    problem = (
        F.when(open_end, "unterminated")
        .when((F.col("total") != F.col("size")) & (F.col("total") != F.col("size") + 1), "changed")
        .when(F.col("value") == "", "blank")
        .when(~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)), "not_object")
    )
    return placed.select("file", "ordinal", "offset", n_bytes.alias("n_bytes"), "value", F.sha2(F.when(open_end, raw).otherwise(F.concat(raw, F.lit(b"\n"))), 256).alias("line_sha256"), "size", "modified", problem.alias("problem"))


def file_states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, size, modified as they are now; no file is read."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_report(lines: DataFrame, now: DataFrame) -> DataFrame:
    """file, n_lines, n_bytes, fault of framed lines: the first problem by ordinal as problem@ordinal, or moved where the file's
    size or time aren't those of `now` (file_states, called after the lines were used); null if the file is sound. Spark's sources
    don't list empty files."""
    whole = lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"), F.min(F.when(F.col("problem").isNotNull(), F.struct("ordinal", "problem"))).alias("first"), F.max("size").alias("size"), F.max("modified").alias("modified"))
    both = now.select("file", F.col("size").alias("size_now"), F.col("modified").alias("modified_now")).join(whole, "file", "full_outer")
    moved = ~F.col("size").eqNullSafe(F.col("size_now")) | ~F.col("modified").eqNullSafe(F.col("modified_now"))
    fault = F.when(F.col("first").isNotNull(), F.concat_ws("@", "first.problem", "first.ordinal")).when(moved, "moved")
    zero = F.lit(0).cast("long")
    return both.select("file", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_bytes", zero).alias("n_bytes"), fault.alias("fault"))


def file_digests(lines: DataFrame) -> DataFrame:
    """file, n, digest: SHA-256 of each file's bytes, as sha256sum gives it, from its framed lines."""
    raw = F.col("value").cast("binary")
    value = F.when(F.coalesce(F.col("problem") == "unterminated", F.lit(False)), raw).otherwise(F.concat(raw, F.lit(b"\n")))
    return ordered_digests(lines.select("file", "ordinal", value.alias("bytes")), group="file", order="ordinal", value="bytes")


def array_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, array_index, value (the element's text), error of the elements of files that each hold one JSON array.

    Files are cut at every comma. A piece tells, for both cases of starting inside a string or not, how many brackets it leaves
    open; sums over a file's splits then say which commas part elements, so that one large array is read by many tasks. A file
    that isn't an array, or whose brackets or strings don't close, is one row with an error and no index. Texts of elements
    aren't parsed here. Empty arrays and empty files (which Spark's sources don't
    list) have no elements; whole files are never in a task's memory."""
    pieces = _pieces(spark, paths, ",")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # what is escaped neither ends strings nor opens anything
    inside = lambda odd: F.array_join(F.filter(F.split(bare, '"'), lambda _, i: i % 2 == odd), "")
    count = lambda text, marks: F.length(text) - F.length(F.translate(text, marks, ""))
    opened = lambda odd: F.transform(F.array(inside(odd)), lambda t: count(t, "[{") - count(t, "]}"))[0].cast("long")
    measured = pieces.withColumns({"quotes": count(bare, '"').cast("long"), "even": opened(0), "odd": opened(1)})
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    measured = measured.withColumn("q", F.sum("quotes").over(own))
    outside = (F.col("q") - F.col("quotes")) % 2 == 0  # this piece's start, where the block starts outside of strings
    a, b = F.when(outside, F.col("even")).otherwise(F.col("odd")), F.when(outside, F.col("odd")).otherwise(F.col("even"))
    measured = measured.withColumns({"a": F.sum(a).over(own), "b": F.sum(b).over(own)})
    # of each block, for both cases: all brackets, and the commas outside of strings by the brackets open there
    cases = measured.select("file", "block", F.col("q"), F.inline(F.array(F.struct(F.lit(0).alias("case"), F.col("a").alias("open")), F.struct(F.lit(1).alias("case"), F.col("b").alias("open")))), "at")
    free = (F.col("q") + F.col("case")) % 2 == 0
    ends = measured.groupBy("file", "block").agg(F.max_by(F.struct("q", "a", "b"), "at").alias("e"), F.min_by("value", "at").alias("head"), F.max_by("value", "at").alias("tail"))
    head, tail, file = r"^[ \t\r\n]*\[", r"\][ \t\r\n]*$", Window.partitionBy("file")
    framed = F.rlike(F.min(F.struct("block", "head")).over(file)["head"], F.lit(head)) & F.rlike(F.max(F.struct("block", "tail")).over(file)["tail"], F.lit(tail))
    begins = ends.select("file", "block", "e", _before("e.q").alias("before"), framed.alias("framed"))
    begins = begins.withColumn("case", (F.col("before") % 2).cast("int")).withColumn("own", F.when(F.col("case") == 0, F.col("e.a")).otherwise(F.col("e.b")))
    begins = begins.withColumns({"depth": _before("own"), "wrong": ~F.col("framed") | (F.sum("own").over(file) != 0) | (F.sum("e.q").over(file) % 2 != 0)})
    commas = cases.where(free).groupBy("file", "block", "case", "open").agg(F.count("*").alias("n"))
    counted = begins.join(commas, ["file", "block", "case"], "left").groupBy("file", "block", "case", "depth", "wrong").agg(F.coalesce(F.sum(F.when(F.col("depth") + F.col("open") == 1, F.col("n"))), F.lit(0)).alias("parts"))
    base = counted.select("file", "block", "case", "depth", "wrong", _before("parts").alias("first"), F.sum("parts").over(file).alias("last"))
    placed = measured.join(base.where("NOT wrong"), ["file", "block"])
    parts = ((F.col("q") + F.col("case")) % 2 == 0) & (F.col("depth") + F.when(F.col("case") == 0, F.col("a")).otherwise(F.col("b")) == 1)
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.col("first") + F.coalesce(F.sum(F.col("parts").cast("long")).over(earlier), F.lit(0))
    numbered = placed.withColumn("parts", parts).withColumn("index", nth)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), ",")
    elements = numbered.groupBy("file", "index").agg(joined.alias("value"), F.max("last").alias("last"))
    text = F.when(F.col("index") == 0, F.regexp_replace("value", head, "")).otherwise(F.col("value"))
    text = F.btrim(F.when(F.col("index") == F.col("last"), F.regexp_replace(text, tail, "")).otherwise(text), F.lit(" \t\r\n"))
    good = elements.select("file", F.col("index").alias("array_index"), text.alias("value"), F.lit(None).cast("string").alias("error"), "last").where("NOT (last = 0 AND value = '')").drop("last")
    bad = base.where("wrong").select("file").distinct().select("file", F.lit(None).cast("long").alias("array_index"), F.lit(None).cast("string").alias("value"), F.lit("the file isn't one whole JSON array").alias("error"))
    return good.unionByName(bad)
