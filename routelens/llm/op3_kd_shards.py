"""Sharding by a k-d tree over document metadata.

All rows of one text form a group, the unit that is placed.  A node of the tree with more than the
target bytes is split: along the dimension in which its groups spread widest, at the weighted quantile
that leaves both sides whole shares of the leaves (the weighted median where the leaves are even).
Each level splits all nodes at once, by a range-partitioned sort of one small row per group and running
sums of its bytes; the driver gets one row per node, at most as many as there are shards.  Leaves are the
shards.

Dimensions are a group's smallest doc_id, its size in bytes, and its smallest source and lang by their rank
among the table's distinct ones, each as a share of its range over the table.  A sort by (dimension, digest) settles ties, so
a node splits within a value as well.  Sizes are near equal: law ``bytes``.

Null text counts as empty, and so is equal to empty text.  A null doc_id is 0, a null source or lang empty.  Rows that repeat a
doc_id are separate rows.  Empty tables give no rows, and other columns are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, ranked, text_or_empty
from routelens.plans.shared import broadcast_if_small, materialize, running_sums

SHARDS = 8
DIMENSIONS = ("by_id", "by_size", "by_source", "by_lang")


def _with_ranks(groups: DataFrame, rows: DataFrame, c: str) -> DataFrame:
    """``groups`` with by_``c``, the rank of its ``c`` among the distinct values of ``rows``, in place of ``c``."""
    values = ranked(rows.select(c).distinct(), [], [c], f"{c}-in-order", "_rank")
    ranks = materialize(values.select(c, F.col("_rank").cast("double").alias(f"by_{c}")), f"{c}-ranks")
    return groups.join(broadcast_if_small(ranks), c).drop(c)


def _groups(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("digest").agg(
        F.sum("size").alias("weight"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("by_id"),
        F.max("size").cast("double").alias("by_size"),
        F.min("source").alias("source"),
        F.min("lang").alias("lang"),
    )
    for c in ("source", "lang"):
        groups = _with_ranks(groups, rows, c)
    return materialize(groups, "text-groups")


def kd_leaves(groups: DataFrame, leaves: int) -> DataFrame:
    """digest, shard for each row of ``groups`` (digest, weight, by_...): a tree of ``leaves`` leaves."""
    ranges = groups.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = {d: (ranges[f"hi_{d}"] or 0) - (ranges[f"lo_{d}"] or 0) or 1.0 for d in DIMENSIONS}
    nodes = groups.withColumn("node", F.lit(0))
    shares = {0: leaves}  # of leaves still to make from each node; a node is named by its first leaf
    while any(n > 1 for n in shares.values()):
        spread = [((F.max(d) - F.min(d)) / scale[d]).alias(d) for d in DIMENSIONS]
        seen = nodes.groupBy("node").agg(F.sum("weight").alias("weight"), *spread).collect()  # a row per node
        splits, after = [], {}
        for r in seen:
            share, left = shares[r.node], shares[r.node] // 2
            widest = max(range(len(DIMENSIONS)), key=lambda i: r[DIMENSIONS[i]])  # noqa: B023
            cut = r.weight * left / share if share > 1 else float("inf")
            splits.append((r.node, widest + 1, cut, left))
            after |= {r.node: left, r.node + left: share - left} if share > 1 else {r.node: 1}
        table = nodes.sparkSession.createDataFrame(splits, "node int, _widest int, _cut double, _left int")
        split = nodes.join(F.broadcast(table), "node")
        split = split.withColumn("_place", F.element_at(F.array(*DIMENSIONS), F.col("_widest")))
        summed = running_sums(split, ["node"], ["_place", "digest"], {"_upto": F.col("weight")})
        right = F.col("_upto") - F.col("weight") / 2.0 > F.col("_cut")  # a group goes where its middle falls
        node = F.col("node") + F.when(right, F.col("_left")).otherwise(0)
        nodes = materialize(summed.withColumn("node", node).select(*groups.columns, "node"), "kd-level")
        shares = after
    return nodes.select("digest", F.col("node").alias("shard"))


def leaves_for(groups: DataFrame, target_bytes: int) -> int:
    """How many leaves of at most about ``target_bytes`` the table needs."""
    return max(1, -(-(groups.agg(F.sum("weight")).first()[0] or 0) // target_bytes))


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: the tree has ``shards`` leaves, or as many as ``target_bytes`` asks for."""
    text = docs.select("doc_id", "source", "lang", text_or_empty().alias("text"))
    rows = text.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")],
    )
    rows = materialize(rows, "shard-rows")
    groups = _groups(rows)
    placed = kd_leaves(groups, shards or leaves_for(groups, target_bytes))
    out = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard")
    return ranked(out, ["shard"], ["doc_id", "text_crc32"], "slots", "slot")


def op3_kd_shards(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
