"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document's expected copies are its source's target divided
by its source's words.  Within a source the documents are laid on a line by size, each as long as its
expected copies.  The line starts at one random offset of the source, and a document is emitted once
for each integer that its piece crosses.  So a source's taken words differ from its target by less
than its largest document, and no document comes more often than its expected copies rounded up.

Places on the line are ranks times expected copies.  Ranks come from a range-partitioned sort, so a
source of any size spreads over many tasks.  Targets are solved from one row per source, in rounds that
bring two numbers to the driver.  The offset is a hash of the source's name: reruns agree.

Null text has no words, a null source is a source of its own and the last; sources without words and
empty tables take nothing.  Rows that repeat a doc_id are separate documents.  Other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import WORD, documents, ranked, text_or_empty
from routelens.plans.shared import materialize

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_TIMES
) -> DataFrame:
    """source, source_size, target for each source of ``sized`` (source, size).

    A target is level * weight, or ``most`` times the source's size where that is less.  The level
    rises in rounds: what capped sources leave over is shared again by weight, until no more are capped.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("_null_last", F.col("source").isNull())
    sources = ranked(sources, [], ["_null_last", "source"], "sources", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "source-weights")

    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("source_size") * most <= level * F.col("weight")
        sums = sources.agg(
            F.count_if(at_cap).alias("n"),
            F.sum(F.when(at_cap, F.col("source_size") * most).otherwise(0)).alias("fixed"),
            F.sum(F.when(at_cap, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums.open or sums.n == capped:
            break
        level, capped = (share * total - sums.fixed) / sums.open, sums.n
    target = F.least((F.col("source_size") * most).cast("double"), level * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A random number in [0, 1) for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "!").otherwise("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def copies(docs: DataFrame, key: list[str] | None = None, seed: int = 0, most: int = MOST_TIMES) -> DataFrame:
    """``key`` (doc_id by default), size, source_size, target, copies for every row of ``docs``."""
    key = key or ["doc_id"]
    sized = docs.select(*key, "source", word_count(text_or_empty()).alias("size"))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized, most=most)
    placed = ranked(sized, ["source"], ["size", *key], "by-size")
    targets = targets.withColumnRenamed("source", "_of")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    crossed = F.floor((F.col("rank") + 1) * each + start) - F.floor(F.col("rank") * each + start)
    return placed.join(targets, F.col("source").eqNullSafe(F.col("_of"))).select(
        *key, "size", "source_size", "target", F.least(crossed, F.lit(most)).alias("copies")
    )


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    hashed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("hash"))
    nth = Window.partitionBy("doc_id", "hash").orderBy("copies")
    times = copies(hashed, ["doc_id", "hash"], seed).select("doc_id", "hash", "copies")
    times = materialize(times.withColumn("nth", F.row_number().over(nth)), "times")
    times = times.withColumnsRenamed({c: f"_mix_{c}" for c in times.columns})
    on = docs["doc_id"].eqNullSafe(times["_mix_doc_id"]) & (F.xxhash64(docs["text"]) == times["_mix_hash"])
    if times.filter("_mix_nth > 1").isEmpty():
        out = docs.join(times.filter("_mix_copies > 0"), on)
    else:  # rows that repeat doc_id and text: the n-th of them takes the n-th count
        nth = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
        numbered = docs.withColumn("_mix_row", F.row_number().over(nth))
        out = numbered.join(times, on & (F.col("_mix_row") == F.col("_mix_nth"))).filter("_mix_copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
    return out.withColumn("_mix_again", again).select(*docs.columns)


def op8_systematic_mixing(spark, sf_dir: str) -> DataFrame:
    out = copies(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words FROM sources),
rounds(k, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * any_value(words)
                         - sum(CASE WHEN source_size * 2 <= level * weight THEN source_size * 2 ELSE 0 END))
                        / sum(CASE WHEN source_size * 2 <= level * weight THEN 0 ELSE weight END)
                 FROM sources, total)
  FROM rounds WHERE k < 40),
targets AS (
  SELECT source, source_size,
         least(CAST(source_size * 2 AS DOUBLE), (SELECT max(level) FROM rounds) * weight) AS target
  FROM sources),
placed AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each_,
         CAST(('0x' || substr(md5('0:' || coalesce(s.source, '') || CASE WHEN s.source IS NULL THEN '!' ELSE '' END), 1, 8)) AS BIGINT)
           / 4294967296.0 AS start_
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor((k + 1) * each_ + start_) - floor(k * each_ + start_), 2) AS BIGINT) * size AS taken
FROM placed
"""
