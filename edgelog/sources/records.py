"""Reader of multi-line log records.

A log is a folder of files that follow each other by name.  Each input partition is a byte range of one file; it owns the
records whose first line begins in the range, and reads on past its end (into later files if need be) to the next first
line.  So a record is whole wherever the cuts fall, nothing is shuffled, and each byte is read once but for the lines that
lead a range.  The lines before a log's first record belong to its first range, as record 0.

Rows: mirror, log, range_no, no_in_range, record, n_lines.  The lines of a record are joined by a newline, a carriage return at
its end goes.  Files are opened through ``pyarrow.fs`` and read in blocks; what a task holds is one block and one record."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from edgelog.sources.namedfiles import filesystem

BLOCK = 4 << 20
RANGE_BYTES, OPEN_COST = 128 << 20, 4 << 20
ROWS = 4096
SCHEMA = "mirror string, log string, range_no int, no_in_range int, record string, n_lines int"


@dataclass
class Range:
    log: str
    file: str
    begin: int
    end: int
    number: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other: small files share tasks."""

    parts: list[Range]


def _files(root: str) -> list[pafs.FileInfo]:
    fs, path = filesystem(root)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    hidden = [i for i in found if any(p.startswith(("_", ".")) for p in posixpath.relpath(i.path, path).split("/"))]
    return sorted((i for i in found if i.type == pafs.FileType.File and i.size and i not in hidden), key=lambda i: i.path)


def _lines(fs: pafs.FileSystem, path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its newline) of the lines that begin at ``begin`` or later."""
    with fs.open_input_file(path) as f:
        at, rest = max(begin - 1, 0), b""
        f.seek(at)
        skip = begin > 0  # up to the end of the line that holds the byte before
        while block := f.read(BLOCK):
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if not skip:
                    yield at, line
                skip = False
                at += len(line) + 1
        if rest and not skip:
            yield at, rest


class RecordReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.tasks = int(options.get("tasks", 1))  # at least so many, if there is enough to read
        self.patterns = json.loads(options["patterns"])  # of mirrors; "" is the default, null: every line is a record
        self.anchored = options.get("anchored", "true").lower() == "true"

    def partitions(self) -> list[Ranges]:
        found = self.ranges()
        cost = sum(r.end - r.begin + OPEN_COST for r in found)
        most = min(max(self.size, OPEN_COST), max(OPEN_COST, cost // self.tasks))
        out, size = [Ranges([])], 0
        for r in found:
            if size and size + r.end - r.begin + OPEN_COST > most:
                out.append(Ranges([]))
                size = 0
            out[-1].parts.append(r)
            size += r.end - r.begin + OPEN_COST
        return out

    def ranges(self) -> list[Range]:
        out, numbers = [], {}
        for info in _files(self.root):
            log = posixpath.dirname(info.path)
            for begin in range(0, info.size, self.size):
                number = numbers[log] = numbers.get(log, -1) + 1
                out.append(Range(log, info.path, begin, min(begin + self.size, info.size), number))
        return out

    def _records(self, part: Range, pattern: str | None) -> Iterator[tuple[int, list[bytes]]]:
        fs, _ = filesystem(self.root)
        begins = None if pattern is None else re.compile(pattern.removeprefix("^").encode())
        begins = begins and (begins.match if self.anchored else begins.search)
        number, lines = -1, None

        def more():
            yield from ((offset < part.end, line) for offset, line in _lines(fs, part.file, part.begin))
            if lines is not None:  # the record may go on in the next files
                for info in _files(part.log):
                    if info.path > part.file and posixpath.dirname(info.path) == part.log:
                        yield from ((False, line) for _, line in _lines(fs, info.path, 0))

        for inside, line in more():
            if begins is None or begins(line):
                if lines is not None:
                    yield number, lines
                if not inside:
                    return
                number, lines = number + 1, [line]
            elif lines is not None:
                lines.append(line)
            elif not inside:
                return
            elif part.number == 0:
                number, lines = 0, [line]
        if lines is not None:
            yield number, lines

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        mirror = re.search(r"mirror=([^/]+)", part.file)
        mirror = mirror[1] if mirror else None
        pattern = self.patterns[mirror] if mirror in self.patterns else self.patterns.get("")
        found: list[tuple[int, str, int]] = []

        def batch() -> pa.RecordBatch:
            n = len(found)
            numbers, records, counts = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([mirror] * n, pa.string()), pa.array([part.log] * n, pa.string()), pa.array([part.number] * n, pa.int32()),
                 pa.array(numbers, pa.int32()), pa.array(records, pa.string()), pa.array(counts, pa.int32())],
                ["mirror", "log", "range_no", "no_in_range", "record", "n_lines"])

        size = 0
        for number, lines in self._records(part, pattern):
            record = b"\n".join(lines).removesuffix(b"\r").decode("utf-8", "replace")
            found.append((number, record, len(lines)))
            size += len(record)
            if len(found) >= ROWS or size >= BLOCK:
                yield batch()
                size = 0
        if found:
            yield batch()


class LogRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgelog_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read_records(spark: SparkSession, root: str, patterns: dict[str, str | None], anchored: bool = True,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all logs below ``root``; ``patterns`` are start patterns by mirror, "" for the others."""
    spark.dataSource.register(LogRecords)
    return (spark.read.format(LogRecords.name()).option("patterns", json.dumps(patterns)).option("anchored", str(anchored))
            .option("rangeBytes", range_bytes).option("tasks", spark.sparkContext.defaultParallelism).load(root))


def with_record_numbers(spark: SparkSession, root: str, records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds ``record_no``, the record's place in its log.  Where every log is one range (the file sizes tell) that is its place
    in the range; else one row per range tells how many records earlier ranges hold, which takes a second scan."""
    own = F.col("no_in_range")
    logs = [posixpath.dirname(i.path) for i in _files(root)]
    if len(set(logs)) == len(logs) and all(i.size <= range_bytes for i in _files(root)):
        return records.withColumn("record_no", own)
    counts = records.groupBy(F.col("log").alias("_log"), F.col("range_no").alias("_range")).agg((F.max("no_in_range") + 1).alias("_n"))
    before = counts.withColumn("_before", (F.sum("_n").over(W.partitionBy("_log").orderBy("_range")) - F.col("_n")).cast("int")).drop("_n")
    joined = records.join(before, (F.col("log") == F.col("_log")) & (F.col("range_no") == F.col("_range")))
    return joined.withColumn("record_no", own + F.col("_before")).drop("_log", "_range", "_before")
