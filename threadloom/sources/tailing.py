"""Growing line logs as a stream: what was appended since the last batch, by lines, each once."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, n_bytes long, value string, line_sha256 string"
#: Bytes before an offset that are remembered by their hash; bytes read at once when a line's end is looked for.
MARKED, STEP = 4096, 65_536


@dataclass
class Range(InputPartition):
    file: str
    start: int  # lines that begin at start or later ...
    end: int  # ... and before end
    known: int  # what was read in earlier batches ends here
    mark: str


def _mark(file: pa.NativeFile, at: int) -> str:
    begin = max(0, at - MARKED)
    file.seek(begin)
    return hashlib.sha256(file.read(at - begin)).hexdigest()


def _whole(file: pa.NativeFile, known: int, size: int) -> int:
    """Where the last line with an end before size ends, known at least."""
    at = size
    while at > known:
        begin = max(known, at - STEP)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return known


class GrowingLinesReader(DataSourceStreamReader):
    """Offsets are, for every file, where its last whole line ends and the hash of the bytes before: kept in the stream's own log.

    A last line without an end waits for the batch in which its end is there. A file that shrank, or whose bytes before the
    offset have another hash, stops the stream: history changed. New bytes are dealt to tasks by ranges that know nothing of
    lines; a range has the lines that begin in it."""

    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.range_bytes = int(options.get("rangeBytes", 32 * 1024 * 1024))
        self.files: dict[str, tuple[int, str]] = {}

    def _open(self, name: str) -> pa.NativeFile:
        system, root = fs.FileSystem.from_uri(self.path)
        return system.open_input_file(f"{root}/{name}" if name else root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = fs.FileSystem.from_uri(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path[len(root) :].lstrip("/")
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            with system.open_input_file(info.path) as file:
                known = self.files.get(name, (0, ""))[0]
                end = _whole(file, min(known, info.size), info.size)
                if end or info.size < known:
                    out[name] = [end if info.size >= known else info.size, _mark(file, end)]
        self.files = {n: (e, m) for n, (e, m) in out.items()}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        gone = sorted(set(start) - set(end))
        if gone:
            raise ValueError(f"history changed: {gone[0]} is gone")
        out = []
        for name, (upto, _) in sorted(end.items()):
            known, mark = start.get(name, (0, hashlib.sha256(b"").hexdigest()))
            if upto < known:
                raise ValueError(f"history changed: {name} shrank")
            cuts = [*range(known, upto, self.range_bytes), upto]
            out += [Range(name, a, b, known, mark) for a, b in zip(cuts, cuts[1:], strict=False)]
            if upto == known and known:
                out.append(Range(name, known, known, known, mark))  # only looked at
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        with self._open(part.file) as file:
            if part.start == part.known and _mark(file, part.known) != part.mark:
                raise ValueError(f"history changed: {part.file} before byte {part.known}")
            at = part.start
            file.seek(max(part.known, at - 1))
            held = b""
            if at > part.known:  # the line that is going on belongs to the range before
                while (found := (held := file.read(STEP)).find(b"\n")) < 0:
                    if not held:
                        return
                    at += len(held) - (at == part.start)
                at += found + 1 - (at == part.start)
                held = held[found + 1 :]
            while at < part.end:
                while (found := held.find(b"\n")) < 0:
                    more = file.read(STEP)
                    if not more:
                        raise ValueError(f"history changed: {part.file} ends before byte {part.end}")
                    held += more
                line, held = held[: found + 1], held[found + 1 :]
                yield part.file, at, len(line), line[:-1].decode("utf-8", "replace"), hashlib.sha256(line).hexdigest()
                at += len(line)


class GrowingLines(DataSource):
    """spark.readStream.format("growing_lines").load(uri of a folder); options glob and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))


def growing_lines(spark: SparkSession, folder: str, *, glob: str = "*.jsonl", range_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """A stream of file, offset, n_bytes, value, line_sha256: every whole line of the files below folder, once, as they grow.

    folder is a URI that Arrow's file systems open (file://, s3://, gs://, hdfs://): Spark's own file source never looks at a
    file again once it has read it. Bytes that aren't UTF-8 become replacement characters; their hash is the line's own."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("glob", glob).option("rangeBytes", str(range_bytes)).load(folder)


def history_faults(stored: DataFrame, now: DataFrame) -> DataFrame:
    """file, offset, fault of stored lines (file, offset, line_sha256) that the files, framed now (sources.framed), lack or have
    with other bytes: a whole check of what tailing itself checks only near its offsets. Names are compared by their last part."""
    name = lambda d: d.withColumn("file", F.regexp_extract("file", r"([^/]*)$", 1)).select("file", "offset", "line_sha256")
    both = name(stored).join(name(now).withColumnRenamed("line_sha256", "found"), ["file", "offset"], "left")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("line_sha256"), "differs")
    return both.select("file", "offset", fault.alias("fault")).where("fault IS NOT NULL")
