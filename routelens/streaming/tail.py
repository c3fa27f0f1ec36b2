"""A streaming source of the lines that are appended to log files.

The offset is the size of every file when the batch was planned, kept by Spark in the query's checkpoint.  A batch reads the
byte ranges by which files grew, cut into pieces of bounded size, one task each.  A line belongs to the range in which its
newline lies: a task looks back from its range for the start of the line, so a line is read once, and whole, however it was
written and wherever ranges meet; the end of a file that has no newline yet waits for it.

A file that has become shorter was truncated or replaced, and is read anew from its start; so is one that was gone in between.
A file that is replaced by a longer one between two batches cannot be told from one that grew.  The first batch of a query
takes existing files from their start or, with ``start`` = ``end``, only what is appended from then on; files that appear later
are always read whole.  Files are opened through ``pyarrow.fs``: local and shared folders, S3, HDFS with its native library.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, bytes read at a time, and bytes looked back at a time.
RANGE_BYTES, BLOCK_BYTES, BACK_BYTES = 64 << 20, 1 << 20, 1 << 16


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before paths of it in a URI."""
    path = path.replace("s3a://", "s3://", 1)
    system, name = fs.FileSystem.from_uri(path)
    scheme = path.split("://")[0] if "://" in path else "file"
    return system, name, f"{scheme}://" if scheme in ("file", "s3") else path[: len(path) - len(name)]


def file_sizes(paths: list[str], pattern: str = "*") -> dict[str, int]:
    """Size by URI of the given files and of the files in the given folders; names that start with . or _ are passed over."""
    out = {}
    for path in paths:
        system, name, before = _open(path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.Directory:
            for x in system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True)):
                inside = x.path[len(name) :].strip("/").split("/")
                if x.type == fs.FileType.File and not any(part[0] in "._" for part in inside) and fnmatch(inside[-1], pattern):
                    out[before + x.path] = x.size
        elif info.type == fs.FileType.File:
            out[before + info.path] = info.size
    return out


def ranges(start: dict[str, int], end: dict[str, int], most: int = RANGE_BYTES) -> list[ByteRange]:
    """What to read to get from one offset to a later one."""
    out = []
    for path, size in sorted(end.items()):
        at = start.get(path, 0)
        at = 0 if size < at else at
        out += [ByteRange(path, a, min(a + most, size)) for a in range(at, size, most)]
    return out


def _line_start(file, at: int) -> int:
    """Where the line that goes on at a place begins."""
    while at > 0:
        low = max(0, at - BACK_BYTES)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_ending_in(part: ByteRange) -> Iterator[list[bytes]]:
    """The lines whose newline lies in a byte range, some at a time, without it."""
    system, name, _ = _open(part.path)
    try:
        file = system.open_input_file(name)
    except FileNotFoundError:
        return
    with file:
        end = min(part.end, file.size())
        at = _line_start(file, min(part.start, end))
        file.seek(at)
        held = []
        while at < end:
            block = file.read(min(BLOCK_BYTES, end - at))
            if not block:
                break
            at += len(block)
            *complete, rest = block.split(b"\n")
            if complete:
                complete[0] = b"".join([*held, complete[0]])
                held = []
                yield complete
            held.append(rest)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.pattern = options.get("pattern", "*")
        self.from_end = options.get("start", "beginning") == "end"
        self.most = int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return file_sizes(self.paths, self.pattern) if self.from_end else {}

    def latestOffset(self) -> dict:
        return file_sizes(self.paths, self.pattern)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return ranges(start, end, self.most)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for lines in lines_ending_in(partition):
            text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(text), pa.string()), text], names=["file_path", "value"])


class LogTail(DataSource):
    """Format ``log_tail``; options ``path`` (files and folders, by comma), ``pattern``, ``start``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file_path string, value string"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def tail_lines(spark: SparkSession, paths: str | list[str], start: str = "end", pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file_path, value)``: the lines that files get, as a stream.  ``start`` is ``end`` or ``beginning``."""
    if start not in ("end", "beginning"):
        raise ValueError(f"start is 'end' or 'beginning', not {start!r}")
    spark.dataSource.register(LogTail)
    wanted = paths if isinstance(paths, str) else ",".join(paths)
    reader = spark.readStream.format("log_tail").option("path", wanted).option("pattern", pattern)
    return reader.option("start", start).option("rangeBytes", range_bytes).load()
