"""Searching by postings against searching texts, while documents come and go."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import postings, search


def test_search_equals_a_scan_of_texts(spark, tmp_path):
    rnd, root = random.Random(7), str(tmp_path / "index")
    word = lambda: "".join(rnd.choice("abcÄé ") for _ in range(rnd.randrange(1, 6)))
    ids = [*range(60), *range(32_760, 32_780), 5_000_000_000]
    rows = [(i, rnd.choice([None, "", "ab", " ".join(word() for _ in range(30))])) for i in ids]
    docs = spark.createDataFrame([*rows, (None, "abc abc")], "doc_id long, text string")
    first, second = docs.where("doc_id < 32770 OR doc_id IS NULL"), docs.where("doc_id >= 32770")

    def same(live):
        for phrase in ("abc", "a Ä", "zzz"):
            want = search.bm25(live, phrase)
            got = {r.id: (r.tf, round(r.score, 9)) for r in postings.ranked(spark, root, phrase).collect()}
            assert got == {r.doc_id: (r.tf, round(r.score, 9)) for r in want.select("doc_id", search.occurrences(F.col("text"), phrase).alias("tf"), "score").collect()}, phrase

    live = docs.where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    assert postings.add_documents(spark, root, "one", first) == "committed" and postings.add_documents(spark, root, "one", first) == "no_op"
    same(live.where("doc_id < 32770"))
    postings.add_documents(spark, root, "two", second)
    same(live)
    gone = spark.createDataFrame([(i,) for i in (1, 2, 3, 32_765, 32_775, 99)], "doc_id long")
    postings.take_away(spark, root, "three", gone)
    same(live.join(gone, "doc_id", "left_anti"))
    back = spark.createDataFrame([(2, "abc ÄÉä bcÄ")], "doc_id long, text string")
    postings.add_documents(spark, root, "four", back)
    same(live.join(gone, "doc_id", "left_anti").unionByName(back))
    with pytest.raises(ValueError):
        postings.candidates(spark, root, "ÄÉ")
    plan = postings.search(spark, root, "zzz")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan


def test_only_the_phrase_s_folders_are_read(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    postings.add_documents(spark, root, "one", docs)
    could = postings.candidates(spark, root, "number ")
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in could.inputFiles() if "bucket=" in f}
    assert could.select(F.sum(F.bitmap_count("bits"))).first()[0] == 200
    plan = could._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
