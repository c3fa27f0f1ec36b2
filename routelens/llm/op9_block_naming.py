"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of fixed size.  The distinct blocks are sorted and get integer
names; then the names of adjacent blocks form pairs, the distinct pairs get integer names, and so on
until each text has one name.  Texts of as many blocks are equal exactly when their names are: a name
stands for one content, at every level.

Blocks travel once, to be made distinct.  Their names are found again by a 64-bit hash, and hashes that
two different blocks share are detected and looked up by content, so no collision merges texts.  Names
are written before use: a lost executor cannot renumber them.  DataFrame functions only.

Null text counts as empty, and an empty text is one empty block.  Rows that repeat a doc_id and a text
are copies like any others; of rows with the smallest doc_id of their group exactly one is kept.  A null
doc_id is greater than any other and kept only where a group has nothing else.  Empty tables give
empty results, and other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import WHITE, documents, same, text_or_empty
from routelens.plans.shared import materialize, union_all

BLOCK_CHARS = 4096
_ROW = ["doc_id", "digest"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def _sorted_names(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer for each distinct row, ascending in each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """Replaces columns ``hash`` and ``block`` by the block's name."""
    distinct = blocks.select("hash", "block").distinct()
    names = materialize(_sorted_names(distinct, ["block"]).select("hash", "name"), "block-names")
    shared = names.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    if shared.isEmpty():
        return blocks.drop("block").join(names, "hash").drop("hash")
    shared = materialize(shared, "shared-hashes")
    alone = blocks.join(shared, "hash", "left_anti").drop("block").join(names, "hash")
    rest = blocks.join(shared, "hash", "left_semi")
    own = materialize(_sorted_names(rest.select("block").distinct(), ["block"]), "shared-hash-names")
    rest = rest.join(own.withColumn("name", -1 - F.col("name")), "block")
    return alone.unionByName(rest.drop("block")).drop("hash")


def _pair_up(level: DataFrame) -> DataFrame:
    """The next level: adjacent names become pairs, and pairs get names."""
    half = (F.col("pos") / 2).cast("int")
    at = level.withColumns({"pos": half, "_odd": F.col("pos") % 2, "size": ((F.col("size") + 1) / 2).cast("int")})
    pairs = at.groupBy(*_ROW, "n_blocks", "size", "pos").agg(
        F.max(F.when(F.col("_odd") == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("_odd") == 1, F.col("name"))), F.lit(-(2**63))).alias("b"),
    )
    names = materialize(_sorted_names(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
    return materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "named-pairs")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of=F.xxhash64) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), n_blocks, name: a row for each row of ``docs``.

    (n_blocks, name) is equal for equal normalised texts and for no others.  The digest only tells
    rows of one doc_id apart on their way through the levels.
    """
    text = docs.select("doc_id", normalised(text_or_empty()).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    rows = text.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.posexplode(cut).alias("pos", "block"), F.ceil(F.greatest(F.char_length("text"), F.lit(1)) / block_chars).cast("int").alias("n_blocks"))
    rows = rows.withColumns({"hash": hash_of("block"), "size": F.col("n_blocks")})
    level = materialize(_name_blocks(rows), "named-blocks")

    single = level.filter("n_blocks = 1").select(*_ROW, "n_blocks", "name")
    longer = level.filter("n_blocks > 1 AND pos = 0").select(*_ROW, "n_blocks")
    left, done = level.filter("size > 1").agg(F.max("size")).first()[0] or 1, []
    while left > 1:
        level, left = _pair_up(level.filter("size > 1")), (left + 1) // 2
        done.append(level.filter("size = 1").select(*_ROW, "name"))
    if not done:
        return single
    named = union_all(done).withColumnsRenamed({k: f"_n_{k}" for k in _ROW})
    on = longer["doc_id"].eqNullSafe(named["_n_doc_id"]) & (longer["digest"] == named["_n_digest"])
    return single.unionByName(longer.join(named, on).select(*_ROW, "n_blocks", "name"))


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    again = Window.partitionBy(*_ROW).orderBy("name")
    rows = identities(docs, block_chars, hash_of).withColumn("copy", F.row_number().over(again))
    rows = materialize(rows, "identities")
    groups = rows.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")  # a table, so that the join can split a large group
    out = rows.join(groups, ["n_blocks", "name"])
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    groups = materialize(exact_groups(docs, block_chars), "exact-groups")
    smallest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    digest = F.sha2(normalised(F.coalesce(docs["text"], F.lit(""))), 256)
    goes = groups.filter(~smallest).select(F.col("doc_id").alias("_goes_id"), F.col("text_sha256").alias("_goes_digest"))
    stay = docs.join(goes, docs["doc_id"].eqNullSafe(goes["_goes_id"]) & (digest == goes["_goes_digest"]), "left_anti")
    if groups.filter(smallest & ~F.col("kept")).isEmpty():
        return stay
    first = Window.partitionBy("doc_id", digest).orderBy(F.lit(0))
    return stay.withColumn("_row_of_doc", F.row_number().over(first)).filter("_row_of_doc = 1").drop("_row_of_doc")


def op9_block_naming(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
