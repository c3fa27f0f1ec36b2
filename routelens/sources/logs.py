"""Text log scan, parsing and per-file format detection."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.paths import normalize_path
from routelens.plans.shared import broadcast_if_small, materialize
from routelens.schemas import TRAFFIC
from routelens.sources.formats import FORMATS, SPECIFIC

# Whitespace stripped from both ends of a line.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Format detection looks at 10 lines and wants 30 % of them to parse.
SAMPLE_LINES = 10
MIN_SHARE = 0.3


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank lines of text logs as ``(file_path, raw_line)``; bad UTF-8 is replaced."""
    return clean_lines(spark.read.text(paths).select(F.col("_metadata.file_path"), "value"))


def clean_lines(lines: DataFrame) -> DataFrame:
    text = F.btrim(F.make_valid_utf8(F.col("value")), F.lit(_BLANKS))
    return lines.select("file_path", text.alias("raw_line")).filter(F.col("raw_line") != "")


def parse_lines(lines: DataFrame, log_format: str | Column, ingest_time: Column) -> DataFrame:
    """Lines -> traffic rows with ``raw_line`` and ``file_path`` kept; unparseable lines drop out.

    ``log_format`` is a format name for all lines, or a column that names the format per line.
    """
    names = [log_format] if isinstance(log_format, str) else list(FORMATS)
    tag = F.lit(log_format) if isinstance(log_format, str) else log_format
    line, helpers, records = F.col("raw_line"), {}, []
    for name in names:
        chosen = F.col("_format") == name
        helpers |= FORMATS[name].columns(line, chosen)
        records.append(F.when(chosen, FORMATS[name].parse(line, ingest_time)))
    split = lines.withColumn("_format", tag).withColumns(helpers)
    # Filtering on the record itself would make Spark push the whole parse below the projections
    # and run it several times per line; a filter on generated columns stays where it is.
    parsed = split.select("file_path", "raw_line", F.inline(F.array(F.coalesce(*records))))
    traffic = parsed.filter("method is not null").withColumn("record_id", F.xxhash64("file_path", "raw_line"))
    return traffic.select(*TRAFFIC.fieldNames(), "raw_line", "file_path")


def with_pattern(traffic: DataFrame, path_patterns: DataFrame | None = None) -> DataFrame:
    """Add ``path_pattern``: computed, or looked up in a ``(path, path_pattern)`` table.

    A path missing from a given table keeps itself as its pattern.
    """
    if path_patterns is None:
        return traffic.withColumn("path_pattern", normalize_path(F.col("path")))
    table = materialize(path_patterns.select("path", F.col("path_pattern").alias("_known")), "patterns")
    return (
        traffic.join(broadcast_if_small(table), "path", "left")
        .withColumn("path_pattern", F.coalesce("_known", "path"))
        .drop("_known")
    )


#: At most so many bytes of a line are held while a head is looked for.
HEAD_BYTES = 1 << 20


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First non-blank lines of each listed file, read without touching the rest of it.

    Blank lines, and blanks that a line starts with, are passed over however many they are.  At a line of
    over ``HEAD_BYTES`` the file gives the complete lines before it, or without any what it starts with.
    """
    import codecs
    import re

    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["file_path"]:
            system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            lines, rest, held, block = [], "", 0, b"-"
            with system.open_input_stream(name) as stream:
                while block and held < HEAD_BYTES and len(lines) < SAMPLE_LINES:
                    block = stream.read(65536)
                    *complete, rest = re.split("\r\n|\n|\r", rest + decoder.decode(block, not block))
                    lines += [x for x in complete if x.strip(_BLANKS)]
                    rest = rest.lstrip(_BLANKS)
                    held = len(rest.encode())
            if rest and (not block or not lines):
                lines.append(rest)
            rows += [(path, x) for x in lines[:SAMPLE_LINES]]
        yield pd.DataFrame(rows, columns=["file_path", "value"])


def head_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The first 10 non-blank lines per file.

    Files are listed by Spark and their heads read in tasks, so detection costs one small read
    per file and never a scan of the data.
    """
    return heads_of(spark.read.format("binaryFile").load(paths).select("_metadata.file_path"))  # no content


def heads_of(files: DataFrame) -> DataFrame:
    """The first 10 non-blank lines of each file of a table (file_path)."""
    return clean_lines(files.repartition("file_path").mapInPandas(_read_heads, "file_path string, value string"))


def detect_formats(heads: DataFrame) -> DataFrame:
    """``(file_path, log_format)`` from sample lines: most parsed lines wins, ties go to the
    earlier format, under 30 % falls back to ``generic``."""
    now = F.lit(None).cast("timestamp_ntz")
    line = F.col("raw_line")
    split = heads
    for name in SPECIFIC:
        split = split.withColumns(FORMATS[name].columns(line))
    counts = split.groupBy("file_path").agg(
        F.count("*").alias("lines"),
        *[F.count(FORMATS[n].parse(line, now)).alias(n) for n in SPECIFIC],
    )
    best = F.greatest(*SPECIFIC)
    choice = F.when(best < F.col("lines") * MIN_SHARE, "generic")
    for name in SPECIFIC:
        choice = choice.when(F.col(name) == best, name)
    return counts.select("file_path", choice.alias("log_format"))


def read_logs(
    spark: SparkSession, paths: str | list[str], ingest_time: Column, log_format: str = "auto"
) -> DataFrame:
    """Scan, detect (unless a format is given) and parse any number of log files."""
    lines = scan_lines(spark, paths)
    if log_format != "auto":
        return parse_lines(lines, log_format, ingest_time)
    return parse_detected(lines, detect_formats(head_lines(spark, paths)), ingest_time)


def parse_detected(lines: DataFrame, formats: DataFrame, ingest_time: Column) -> DataFrame:
    """Parse each line by its file's format (file_path, log_format)."""
    formats = materialize(formats, "formats")  # one row per file
    return parse_lines(lines.join(broadcast_if_small(formats), "file_path"), F.col("log_format"), ingest_time).drop("log_format")
