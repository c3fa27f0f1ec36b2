"""Plan building blocks: written intermediates, exact ranks without hot tasks, grouped top-k.

Intermediates that several steps read, or that cut the lineage of a loop, are written as Parquet
into the folder named by ``spark.checkpoint.dir``.  They survive the loss of any executor, and a
join with such a table is planned from its real size: below ``autoBroadcastJoinThreshold``
Catalyst broadcasts it, ``broadcast_if_small`` allows somewhat more after measuring it, and
anything larger is shuffled, where AQE splits skewed partitions.
"""

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own; a cluster
    without it is an error, because a machine-local folder would not be visible to its executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="routelens-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/routelens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A table may be broadcast up to this many rows and this many bytes of Parquet.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(written: DataFrame) -> bool:
    """Whether the measured rows and bytes of a written table, from file metadata, allow a broadcast."""
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """Mark a written table for broadcast when its measured rows and bytes allow it.

    Worth it where the other side is raw log data, which would otherwise be shuffled.  A larger
    table is returned as it is: the join then shuffles, and AQE splits the partitions of hot keys,
    unless an aggregation by the same keys follows in the same stage: use ``spread_join`` there.
    """
    return F.broadcast(written) if is_small(written) else written


#: Copies of the written side's rows in a join that cannot broadcast them.
SPREAD = 16


def spread_join(raw: DataFrame, written: DataFrame, keys: list[str], row: Column, how: str = "inner") -> DataFrame:
    """Join raw rows to a written table with one row per key, before an aggregation by the keys.

    A table too large to broadcast is joined by (keys, salt): its rows are repeated for each salt
    and ``row``, a number that differs between rows of a key, chooses one.  So a key's rows go to
    several tasks, and as the salt is no key of the aggregation that follows, that aggregation
    combines map-side and shuffles again, instead of taking the join's tasks over.
    """
    if is_small(written):
        return raw.join(F.broadcast(written), keys, how)
    salted = written.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = raw.withColumn("_salt", F.pmod(row, F.lit(SPREAD)).cast("int"))
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: int = 64) -> DataFrame:
    """The first ``k`` rows of each group, exact also when one group holds most of the data.

    Rows are first ranked within (group, slice of input partitions) and only the survivors are
    ranked within the group.  Spark turns both ``row_number() <= k`` filters into group limits
    that run before their shuffle, so a map task never ships more than ``k`` rows per group.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id() % spread)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    few = sliced.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k)
    return few.drop("_slice").withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= k)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exact inclusive running sums per group, in ``order``, for groups of any size.

    The rows are range-partitioned by (keys, order) and written, so each chunk is a contiguous
    run of about equal size no matter how the keys are skewed.  Every window below is confined to
    one chunk; what earlier chunks add comes from a table with one row per (group, chunk).
    ``keys`` must not hold NULLs.  ``_chunk`` stays in the result.
    """
    parts = [F.col(c) for c in (*keys, *order)]
    ranged = df.withColumns({f"_in_{n}": c.cast("bigint") for n, c in sums.items()})
    ranged = ranged.repartitionByRange(*parts).withColumn("_chunk", F.spark_partition_id())
    chunked = materialize(ranged, "chunks")

    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:  # one row per chunk: a single ordered pass over these is small by construction
        totals = totals.withColumn("_all", F.lit(0))
        earlier = Window.partitionBy("_all").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns({n: F.sum(f"_in_{n}").over(within) + F.col(f"_o_{n}") for n in sums})
    return out.drop(*[f"_in_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def with_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Global 0-based sequence number in ``order``, without moving all rows into one task."""
    out = running_sums(df, [], order, {name: F.lit(1)})
    return out.withColumn(name, F.col(name) - 1).drop("_chunk")


def as_of_lookup(rows: DataFrame, table: DataFrame, at: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the last row of ``table`` whose ``at`` is not after theirs; NULL before the first.

    Both are sorted together over the cluster, table rows first among equals, and cut into chunks; the last value is carried
    on within each chunk, and from chunk to chunk by one row each.  So neither side is broadcast and no key is hot.
    ``at`` is unique in ``table`` and not NULL in either.
    """
    here = [c for c in rows.columns if c not in (at, value)]
    held = F.struct(F.col(value).alias("value"))
    both = table.select(at, F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).alias("_row")).unionByName(
        rows.select(at, F.lit(1).alias("_side"), F.lit(None).alias("_held"), F.struct(*here).alias("_row"))
    )
    ranged = both.repartitionByRange(at, "_side").withColumn("_chunk", F.spark_partition_id())
    chunked = materialize(ranged, "as-of")
    last = chunked.filter("_side = 0").groupBy("_chunk").agg(F.max_by("_held", at).alias("_last"))
    chunks = chunked.select("_chunk").distinct().join(last, "_chunk", "left")
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    carried = chunks.select("_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_chunk").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = chunked.withColumn("_seen", F.last("_held", ignorenulls=True).over(within)).filter("_side = 1")
    out = seen.join(F.broadcast(carried), "_chunk")
    return out.select(at, "_row.*", F.coalesce("_seen", "_carried")["value"].alias(value))
