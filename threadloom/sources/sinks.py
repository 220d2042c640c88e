"""Sinks: content-addressed copies, insert and upsert into Parquet, and rendered reports."""

from __future__ import annotations

import hashlib
import html
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.snapshots import insert_if_absent, upsert
from threadloom.sources.commits import committed, publish


def asset_path(sha256: str) -> str:
    return f"assets/sha256/{sha256[:2]}/{sha256}"


def asset_table(files: DataFrame) -> DataFrame:
    """sha256, size, storage_path, content of binaryFile rows, one for each content."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.dropDuplicates(["sha256"]).select("sha256", F.col("length").alias("size"), F.concat(F.lit("assets/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("storage_path"), "content")


def read_asset(assets: DataFrame, sha256: str) -> DataFrame:
    """The asset of that hash, if its content still has it."""
    return assets.where((F.col("sha256") == sha256) & (F.sha2("content", 256) == sha256))


def insert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key the table at path lacks; makes the table if there is none."""
    try:
        new = insert_if_absent(spark.read.parquet(path), new, keys)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        new = new.dropDuplicates(keys)
    new.write.mode("append").parquet(path)


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, to: str, keys: list[str]) -> None:
    """Writes the table at path with new's rows in place to `to`; readers switch when it is whole."""
    upsert(spark.read.parquet(path), new, keys).write.mode("errorifexists").parquet(to)


def render_conversation(title: str, messages: Iterable[Mapping]) -> str:
    """One conversation as HTML: every text is escaped, nothing is loaded from elsewhere."""
    body = "\n".join(f'<section class="{html.escape(str(m["role"]), quote=True)}"><h2>{html.escape(str(m["role"]))}</h2><pre>{html.escape(m["text"] or "")}</pre></section>' for m in messages)
    return f'<!doctype html>\n<html lang="en">\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n{body}\n</html>\n'


#: How HTML writes characters that would be markup.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, written in ESCAPES:
        out = F.replace(out, F.lit(mark), F.lit(written))
    return out


def render_conversations(messages: DataFrame, *, thread: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """thread, html, sha256: a page for each conversation, as render_conversation writes it, by column functions. A conversation
    is one row's array, as a page needs it whole."""
    pages = messages.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(role).cast("string"), F.lit("None")).alias("role"), F.col(text).alias("text")))).alias("m"))
    section = lambda m: F.concat(F.lit('<section class="'), escaped(m["role"]), F.lit('"><h2>'), escaped(m["role"]), F.lit("</h2><pre>"), escaped(m["text"]), F.lit("</pre></section>"))
    title = escaped(F.coalesce(F.col(thread).cast("string"), F.lit("None")))
    head = F.concat(F.lit('<!doctype html>\n<html lang="en">\n<meta charset="utf-8">\n<title>'), title, F.lit("</title>\n<h1>"), title, F.lit("</h1>\n"))
    page = F.concat(head, F.array_join(F.transform("m", section), "\n"), F.lit("\n</html>\n"))
    return pages.select(thread, page.alias("html")).withColumn("sha256", F.sha2("html", 256))


def write_pages(spark: SparkSession, root: str, key: str, messages: DataFrame, *, thread: str, order: str, role: str = "role", text: str = "text") -> str:
    """The pages of a snapshot's conversations and an index of them (thread, sha256, size, messages), visible together (see
    sources.commits). "committed", or "no_op" if the same pages are there."""
    pages = render_conversations(messages, thread=thread, order=order, role=role, text=text).withColumnRenamed(thread, "thread")
    counts = messages.groupBy(F.col(thread).alias("thread")).agg(F.count("*").alias("messages"))
    index = pages.select("thread", "sha256", F.octet_length("html").cast("long").alias("size")).join(counts.withColumnRenamed("thread", "t"), F.col("thread").eqNullSafe(F.col("t"))).drop("t")
    return publish(spark, root, key, {"pages": pages.select("thread", "html"), "index": index})


def page_faults(spark: SparkSession, root: str) -> DataFrame:
    """snapshot_key, thread, fault of all committed pages against their indexes: missing (indexed, but not there), unexpected (there,
    but not indexed), altered (another hash), repeated (more than one page). One hash join; pages are hashed where they are."""
    have = committed(spark, root, "pages").select("snapshot_key", "thread", F.sha2("html", 256).alias("found"))
    have = have.groupBy("snapshot_key", "thread").agg(F.count("*").alias("n"), F.max("found").alias("found"))
    want = committed(spark, root, "index").select(F.col("snapshot_key").alias("k"), F.col("thread").alias("t"), "sha256")
    both = have.join(want, (F.col("snapshot_key") == F.col("k")) & F.col("thread").eqNullSafe(F.col("t")), "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("k").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("found") != F.col("sha256"), "altered")
    return both.select(F.coalesce("snapshot_key", "k").alias("snapshot_key"), F.coalesce("thread", "t").alias("thread"), fault.alias("fault")).where("fault IS NOT NULL")


STORED = "sha256 string, size long, storage_path string, state string"


def store_assets(files: DataFrame, root: str, *, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """sha256, size, storage_path, state (written or present): the files, named by URI and SHA-256, copied below `root` to the places
    their hashes give them, by the tasks that read them. Evaluate it once: it copies whenever it runs.

    A copy is made beside its place, hashed on the way, and moved there when it is whole, so that tasks that write one asset at
    the same time, or again after a lost executor, leave one whole file. A source whose bytes have another hash, and a file in the
    place that has other bytes, are errors. Any file system that Arrow opens will do; one content is copied once."""

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for source, wanted in zip(batch["path"], batch["sha256"], strict=True):
                place = asset_path(wanted)
                target, state = f"{base}/{place}", "written"
                there = system.get_file_info(target).type == fs.FileType.File
                if there:
                    size, found = _copied(system.open_input_stream(target), None)
                    state = "present"
                else:
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    beside = f"{target}.{uuid.uuid4().hex}.part"
                    own, name = fs.FileSystem.from_uri(source)
                    with system.open_output_stream(beside) as out:
                        size, found = _copied(own.open_input_stream(name), out)
                    if found == wanted:
                        system.move(beside, target)
                    else:
                        system.delete_file(beside)
                if found != wanted:
                    raise ValueError(f"{target if there else source} has other bytes than {wanted}")
                rows.append((wanted, size, place, state))
            yield pd.DataFrame(rows, columns=["sha256", "size", "storage_path", "state"])

    once = files.select(F.col(path).alias("path"), F.col(sha256).alias("sha256")).dropDuplicates(["sha256"])
    return once.mapInPandas(copies, STORED)


def _copied(source: pa.NativeFile, out: pa.NativeFile | None) -> tuple[int, str]:
    size, total = 0, hashlib.sha256()
    with source:
        while part := source.read(1 << 20):
            size += len(part)
            total.update(part)
            if out is not None:
                out.write(part)
    return size, total.hexdigest()


def markdown_table(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report's table of aggregates; more than `most` rows are an error, as a report is for reading."""
    names = rows.columns
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{title}: more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"## {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *[f"| {' | '.join(cell(r[n]) for n in names)} |" for r in found], ""])
