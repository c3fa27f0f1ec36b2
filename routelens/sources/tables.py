"""Parquet tables: append-only logs, versioned inventory snapshots, JSON reports.

Snapshots are never overwritten in place.  Version ``v`` is written to its own folder and becomes
visible through a one-row commit file, so readers and retries always see a complete version.

State that adds up (``fold_state``) is kept as one small delta per batch on top of a snapshot that
is renewed every few batches, so a batch writes about as much as it holds, not the whole state.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "version bigint"


def append_traffic(traffic: DataFrame, path: str, ingested_at: Column) -> None:
    """Append traffic partitioned by day; the time filters of the statistics prune on ``dt``.

    No shuffle: every input task writes its own file per day it holds rows of.
    """
    rows = traffic.withColumns(
        {"dt": F.col("timestamp").cast("date"), "ingested_at": ingested_at.cast("timestamp_ntz")}
    )
    rows.write.mode("append").partitionBy("dt").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int, *partition_by: str) -> None:
    """Write one batch into its own partition; a repeated batch replaces itself."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_if_exists(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one before its first write."""
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Newest committed version, or the newest one below ``before``."""
    if not _exists(spark, f"{root}/commits"):
        return None
    commits = spark.read.schema(COMMITS).option("recursiveFileLookup", "true").json(f"{root}/commits")
    if before is not None:
        commits = commits.filter(F.col("version") < before)
    return commits.agg(F.max("version")).first()[0]


def write_snapshot(rows: DataFrame, root: str, version: int) -> None:
    """Write a version, then commit it.  Writing the same version again gives the same state."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    commit = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    commit.coalesce(1).write.mode("overwrite").json(f"{root}/commits/{version}")


def read_snapshot(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    version = latest_version(spark, root, before)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/versions/{version}")


# A new snapshot replaces the deltas after this many batches.
COMPACT_EVERY = 20


def fold_state(
    root: str, batch: DataFrame, batch_id: int, merge: Callable[..., DataFrame], compact_every: int = COMPACT_EVERY,
    upto: int | None = None,
) -> DataFrame:
    """Add a batch to a state table and return the whole state, merged on read.

    ``merge`` combines any number of states into one.  Only batches up to ``batch_id``, or up to a later
    ``upto``, count, so a batch that is run again sees the state it saw the first time.  A batch whose old
    delta is part of a snapshot up to ``upto`` cannot be replaced there any more: that is an error.
    """
    spark, schema = batch.sparkSession, batch.schema
    newest = latest_version(spark, root, before=upto + 1) if upto is not None else None
    if newest is not None and newest > batch_id:
        raise ValueError(f"batch {batch_id} is part of the snapshot of batch {newest}; replay from a copy of the older state")
    write_batch(batch, f"{root}/deltas", batch_id)
    last = max(batch_id, upto or 0)
    base = latest_version(spark, root, before=batch_id)
    deltas = spark.read.schema(schema).parquet(f"{root}/deltas")  # batch_id comes from the folder names
    newer = deltas.filter((F.col("batch_id") > (-1 if base is None else base)) & (F.col("batch_id") <= last))
    state = merge(read_snapshot(spark, root, schema, before=batch_id), newer.drop("batch_id"))
    if last > batch_id or batch_id - (-1 if base is None else base) < compact_every:
        return state
    write_snapshot(state, root, batch_id)
    return read_snapshot(spark, root, schema, before=batch_id + 1)


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text in column ``value``."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered ``line`` rows as text; part files in name order form the document."""
    lines.select("line").write.mode("overwrite").text(path)
