"""License scans by canonical digest lookup (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.license_texts import NOTICES, TEXTS
from threadloom.llm.shared import columns, text_or_empty, unused, without

#: Spellings that count as equal, each replaced by the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("catalogue", "catalog"),
    ("cheque", "check"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http://", "https://"),
    ("&", "and"),
)
#: A line that only says who holds the copyright.
COPYRIGHT_LINE = r"^[^a-z0-9\n(©]*(copyright\s?(\(c\)|©|[0-9]|<|\[|:)|\(c\) ?[0-9]|© ?[0-9]|all rights reserved)[^\n]*$"
MAX_REGISTRY = 10_000


def canonical_lines(text: Column) -> Column:
    """text in lower case, without copyright lines, with one spelling for equivalent ones and a single space for each run
    of anything but letters and digits; line ends stay."""
    out = F.regexp_replace(F.lower(text), "(?dm)" + COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n")


def canonical_text(text: Column) -> Column:
    """The canonical lines as one line."""
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def registry(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id, digest: known licenses by the SHA-256 of their canonical text."""
    rows = [(k, v) for k, v in (TEXTS if texts is None else texts).items()]
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.groupBy(F.sha2(canonical_text(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, *, text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """docs with license_digest (SHA-256 of the whole canonical text), license_id (the known license that the whole text
    is, or null), notices (array<string>, sorted: licenses named by lines that are a known notice) and n_license_lines
    (long: such lines).

    A null or empty text has the digest of the empty text and no license. The registry is broadcast up to MAX_REGISTRY
    licenses, and joined by a shuffle beyond; else the documents are not shuffled. Rows that repeat get equal results. Columns
    with a result's name give way, others stay."""
    known = registry(docs.sparkSession, texts).select(F.col("digest").alias("license_digest"), "license_id")
    known = F.broadcast(known) if len(TEXTS if texts is None else texts) <= MAX_REGISTRY else known
    text, docs = text_or_empty(text_col), without(docs, "license_digest", "license_id", "notices", "n_license_lines")
    canonical, hits = unused(docs, "canonical"), unused(docs, "hits")
    by_line = {(NOTICES if notices is None else notices)[k]: k for k in sorted(NOTICES if notices is None else notices)}
    ids = docs.sparkSession.createDataFrame([(v, k) for k, v in by_line.items()], "id string, line string").select("id", canonical_text(F.col("line")).alias("line")).collect()
    pairs = F.create_map(*[F.lit(x) for r in ids for x in (r["line"], r["id"])]) if ids else F.create_map().cast("map<string,string>")
    lines = F.array(*[F.lit(r["line"]) for r in ids]) if ids else F.array().cast("array<string>")
    out = docs.withColumn(canonical, canonical_lines(text))
    hit = F.filter(F.split(canonical, "\n"), lambda x: F.array_contains(lines, F.trim(x)))
    out = out.withColumn(hits, hit).withColumn("license_digest", F.sha2(F.trim(F.regexp_replace(canonical, "[ \n]+", " ")), 256))
    out = out.withColumn("n_license_lines", F.size(hits).cast("long")).withColumn("notices", F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.element_at(pairs, F.trim(x))))))
    return out.join(known, "license_digest", "left").select(*columns(docs), "license_digest", "license_id", "notices", "n_license_lines")
