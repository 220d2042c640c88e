"""A trigram index of documents: postings as bitmaps by trigram and block of ids, searched instead of the texts.

An index is a folder of commits (sources.commits): each adds documents with their postings, or takes documents away, and becomes
visible as a whole. A phrase is looked for in the bitmaps of its trigrams alone; the texts of the documents in which all of them
occur are then read, by blocks, and compared. Ids are integers, best without large gaps, as a block is 32768 of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import contains_folded
from threadloom.operators.search import B, K1, LEAST_IDF, occurrences, trigrams
from threadloom.sources.commits import commits, committed, publish

#: Folders that trigrams are dealt to; blocks whose numbers are given to the scan of the texts.
BUCKETS, MOST_BLOCKS = 64, 1000


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """bucket, trigram, block, bits: in which documents a trigram of the lower-cased text occurs, a bit for each id of a block.

    A document gives each of its trigrams once; bits are set map-side, so that a trigram of all documents is one row a task and
    block. Null and short texts have none."""
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(trigrams(F.col(text_col)))).alias("trigram"))
    bits = each.groupBy("trigram", F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return bits.select(_bucket(F.col("trigram")).alias("bucket"), "trigram", "block", "bits")


def add_documents(spark: SparkSession, root: str, key: str, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Adds docs (id_col and text_col) to the index as commit `key`; "committed", or "no_op" if they are there already. Rows with a
    null id are left out; ids are taken once in an index, and again only after they were taken away."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.bitmap_bucket_number(F.col(id_col).cast("long")).alias("block"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = postings(texts, id_col="id", text_col="text").repartition("bucket", "block").sortWithinPartitions("bucket", "trigram")
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id")  # so that a file's statistics tell its blocks
    sums = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.length("text") - 2, F.lit(0))), F.lit(0)).cast("long").alias("trigrams"))
    return publish(spark, root, key, {"texts": ordered, "postings": own, "sums": sums}, layout={"postings": ["bucket"]})


def take_away(spark: SparkSession, root: str, key: str, ids: DataFrame, *, id_col: str = "doc_id") -> str:
    """Takes the documents with these ids out of the index, as commit `key` (used once): those that are in it now."""
    there = _live(spark, root).join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    gone = there.select("id", "block", F.col("snapshot_key").alias("of"), F.greatest(F.length("text") - 2, F.lit(0)).cast("long").alias("trigrams"))
    return publish(spark, root, key, {"gone": gone})


def _table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    held = commits(spark, root).where(F.map_contains_key("tables", F.lit(name)))
    return None if held.isEmpty() else committed(spark, root, name)


def _live(spark: SparkSession, root: str, blocks: list[int] | None = None) -> DataFrame:
    texts = committed(spark, root, "texts")
    if blocks is not None:
        texts = texts.where(F.col("block").isin(blocks))
    gone = _table(spark, root, "gone")
    return texts if gone is None else texts.join(gone.select("id", F.col("of").alias("snapshot_key")), ["id", "snapshot_key"], "left_anti")


def candidates(spark: SparkSession, root: str, phrase: str) -> DataFrame:
    """block, bits of the blocks in which documents have all trigrams of phrase (three characters or more), commit by commit.

    Only the folders of the phrase's trigrams are read. Bitmaps are united over commits and cut with each other by aggregation,
    so that no list of ids is ever made."""
    grams = spark.range(1).select(F.array_distinct(trigrams(F.lit(phrase))).alias("g")).select(F.explode("g").alias("trigram"), _bucket(F.col("trigram")).alias("bucket")).collect()
    if not grams:
        raise ValueError("a phrase of three characters or more is needed")
    found = committed(spark, root, "postings").where(F.col("bucket").isin([r["bucket"] for r in grams]) & F.col("trigram").isin([r["trigram"] for r in grams]))
    united = found.groupBy("block", "trigram").agg(F.bitmap_or_agg("bits").alias("bits"))
    cut = united.groupBy("block").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).where(F.col("n") == len(grams))
    return cut.where(F.bitmap_count("bits") > 0).select("block", "bits")


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (F.floor(byte / F.pow(F.lit(2), position % 8)) % 2) == 1


def search(spark: SparkSession, root: str, phrase: str) -> DataFrame:
    """id, text of the documents whose text holds phrase, without regard to case.

    Texts are read for candidates only: if they lie in MOST_BLOCKS blocks at most, the scan is given the blocks' numbers, by which
    it leaves out files and row groups; else all blocks are joined. What is found is compared with the phrase itself."""
    could = candidates(spark, root, phrase)
    blocks = [r["block"] for r in could.select("block").limit(MOST_BLOCKS + 1).collect()]
    texts = _live(spark, root, blocks if len(blocks) <= MOST_BLOCKS else None)
    held = texts.join(could, "block").where(_bit(F.col("bits"), F.bitmap_bit_position("id")))
    return held.where(contains_folded(F.col("text"), phrase)).select("id", "text")


def ranked(spark: SparkSession, root: str, phrase: str) -> DataFrame:
    """id, tf, score of the documents that hold phrase, by the index: the scores of operators.search.bm25. How many documents
    there are and how long is kept by commit, so that no other text is read for it."""
    found = search(spark, root, phrase).select("id", occurrences(F.col("text"), phrase).cast("long").alias("tf"), F.greatest(F.length("text") - 2, F.lit(0)).alias("dl"))
    sums = committed(spark, root, "sums").agg(F.sum("n").alias("n"), F.sum("trigrams").alias("t")).first()
    gone = _table(spark, root, "gone")
    less = gone.agg(F.count("*").alias("n"), F.sum("trigrams").alias("t")).first() if gone is not None else {"n": 0, "t": 0}
    n, mean, df = sums["n"] - less["n"], (sums["t"] - (less["t"] or 0)) / max(1, sums["n"] - less["n"]), found.count()
    idf = F.greatest(F.lit(LEAST_IDF), F.log(F.lit((n - df + 0.5) / (df + 0.5))))
    tf = F.col("tf").cast("double")
    return found.select("id", "tf", (-idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean) or 1.0)))).alias("score"))
