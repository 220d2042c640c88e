"""Imports of several tables that become visible together: staged data, and a log with one entry for each snapshot."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, attempt string, profile string, tables map<string, struct<rows: bigint, digest: string>>"


def table_digest(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and a digest of them in which their order doesn't count: each row's SHA-256 is four words, and the words'
    exact sums are hashed. Sums are made map-side, so that no rows meet anywhere; repeated rows count each."""
    kinds = dict(rows.dtypes)
    short = [F.sha2(F.col(c), 256).alias(c) if kinds[c] == "binary" else F.col(c) for c in sorted(rows.columns)]
    row = F.sha2(F.to_json(F.struct(*short), {"ignoreNullFields": "false"}), 256)
    word = lambda i: F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    got = rows.agg(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in range(4)]).first()
    return got["n"], hashlib.sha256(":".join(str(got[f"w{i}"] or 0) for i in range(4)).encode()).hexdigest()


def commits(spark: SparkSession, root: str) -> DataFrame:
    """key, attempt, profile, tables (rows and digest by name) of all committed snapshots; more than one entry for a key, which
    only writers that race for it can make, is an error."""
    try:
        log = spark.read.text(f"{root}/_log/*/part-*").select(F.from_json("value", ENTRY).alias("e")).select("e.*")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], ENTRY)
    twice = log.groupBy("key").count().where("count > 1").first()
    if twice:
        raise ValueError(f"snapshot {twice['key']} was committed by two writers")
    return log


def _stored(spark: SparkSession, root: str, table: str, attempt: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{table}/attempt={attempt}")


def publish(spark: SparkSession, root: str, key: str, tables: dict[str, DataFrame], *, profile: dict | None = None, layout: dict[str, list[str]] | None = None) -> str:
    """"committed" when the tables of snapshot `key` are new and now visible, "no_op" when they were there and are sound.

    All tables are written below data/ under an attempt of their own and read back for their digests; then one log entry is
    written, whose single file Spark's committer renames into place. Readers go by the log, so that a crash before that leaves
    nothing visible and the next call starts anew. A key that is in the log is held against it instead: another profile, other
    tables or digests than those given now, or stored data whose digests aren't the log's, are errors. Null and nested columns
    count in digests; empty tables are tables. layout names columns that a table's folders are parted by. One writer at a time may publish a key."""
    wanted = json.dumps(profile or {}, sort_keys=True)
    known = commits(spark, root).where(F.col("key") == key).first()
    if known:
        if known["profile"] != wanted:
            raise ValueError(f"snapshot {key} was committed with another profile")
        logged = {n: (t["rows"], t["digest"]) for n, t in known["tables"].items()}
        if logged != {n: table_digest(t) for n, t in tables.items()}:
            raise ValueError(f"snapshot {key} was committed with other content")
        if logged != {n: table_digest(_stored(spark, root, n, known["attempt"])) for n in logged}:
            raise ValueError(f"the stored tables of snapshot {key} have changed")
        return "no_op"
    attempt, digests = uuid.uuid4().hex, {}
    for name, rows in tables.items():
        rows.write.partitionBy(*(layout or {}).get(name, [])).parquet(f"{root}/data/{name}/attempt={attempt}")
        n, digest = table_digest(_stored(spark, root, name, attempt))
        digests[name] = {"rows": n, "digest": digest}
    entry = json.dumps({"key": key, "attempt": attempt, "profile": wanted, "tables": digests})
    place = f"{root}/_log/{hashlib.sha256(key.encode()).hexdigest()}"
    spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(place)
    commits(spark, root)
    return "committed"


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table in all committed snapshots, with their key as snapshot_key. Folders of other attempts aren't read."""
    log = [(r["key"], r["attempt"]) for r in commits(spark, root).where(F.map_contains_key("tables", F.lit(table))).select("key", "attempt").collect()]
    if not log:
        raise ValueError(f"no snapshot with a table {table} is committed")
    rows = spark.read.option("basePath", f"{root}/data/{table}").option("mergeSchema", "true").parquet(*[f"{root}/data/{table}/attempt={a}" for _, a in log])
    names = spark.createDataFrame([(a, k) for k, a in log], "attempt string, snapshot_key string")
    return rows.withColumn("attempt", F.col("attempt").cast("string")).join(F.broadcast(names), "attempt").drop("attempt")


def damaged(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(key, table) of committed tables whose stored rows aren't those of the log."""
    out = []
    for entry in commits(spark, root).collect():
        for name, want in entry["tables"].items():
            try:
                sound = table_digest(_stored(spark, root, name, entry["attempt"])) == (want["rows"], want["digest"])
            except AnalysisException:  # the folder is gone
                sound = False
            if not sound:
                out.append((entry["key"], name))
    return out
