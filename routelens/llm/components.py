"""Connected components of a graph given as links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.plans.shared import materialize


def _to_smallest(pairs: DataFrame, label: str) -> DataFrame:
    """``pairs`` (u, v) with the smallest v of each u; a u with many pairs is split when it is joined."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("least")), label)
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node that it reaches.

    Rounds of two steps: every node's greater neighbours are linked to its smallest neighbour, then every
    node and its smaller neighbours to the smallest of them.  The number of links never grows, and the
    rounds end, as the logarithm of the longest path, when each node is linked to its root alone.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    links, before = materialize(links.distinct(), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, "large-star").filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
        large = materialize(large, "large-linked")
        small = _to_smallest(large, "small-star")
        small = small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("x"))
        links = materialize(small.select("x.u", "x.v").filter("u <> v").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
