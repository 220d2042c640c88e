"""Helpers that every operator of this subpackage may use: shared tables, text columns, checked broadcasts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java/Python/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: The same characters, for translate() and trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or on a local master a folder under /tmp."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it are of no more use then. Spark deletes them once the driver's JVM has collected their
    handles, which is asked for here; else all steps' files would stay on the executors' disks together."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a shared table that nothing reads any more; else they would stay until the program ends."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            return


def checked_broadcast(table: DataFrame, max_rows: int) -> DataFrame:
    """table with a broadcast hint if it was counted to at most max_rows; else as it is, for a shuffled join.

    table should be a shared_table, so that counting reads Parquet footers only."""
    return F.broadcast(table) if table.count() <= max_rows else table


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without the columns that bear a name of an operator's results: these give way. Case doesn't count."""
    low = {n.lower() for n in names}
    return docs.select(*[c for n, c in zip(docs.columns, columns(docs), strict=True) if n.lower() not in low])


def columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def unused(docs: DataFrame, name: str) -> str:
    """A name for a column of an operator's own that none of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of text; an empty array if it has none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
