"""Plan helpers that several operators share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from routelens.plans.shared import materialize

#: ASCII white space, as the operators' contracts name it, and what lies between it.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a map: sixteen for each key that it holds, from 1 Mbit to this many (64 MiB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def ranked(df: DataFrame, group: list[str], order: list[str], label: str, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row within ``group`` by ``order``, for groups of any size.

    Rows are range-partitioned and sorted by (group, order) and written, so each file is a contiguous
    run of the whole order and a group of any size spreads over many of them.  A row's place in its run
    comes with the sort; what earlier runs hold of its group is summed over one row per (group, run).
    """
    cols = [F.col(c) for c in (*group, *order)]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_run", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_run", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    keys = [*group, "_run"]
    joined = placed.join(runs.withColumnsRenamed({k: f"_r_{k}" for k in keys}), _on(placed, keys))
    out = joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    return out.drop("_at", "_run", "_first", "_before", *[f"_r_{k}" for k in keys])


def _on(df: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"_r_{k}"))
    return on


def with_text_columns(df: DataFrame, fn, fields: str, keep_text: bool = False, text: str = "text") -> DataFrame:
    """``df`` without its text, or with it, and with the columns that ``fn`` makes from lists of texts.

    ``fn`` maps a list of strings (null is "") to a list of columns in the order of ``fields``, a DDL
    string.  All other columns pass unread.  Runs on Arrow batches, a batch at a time.
    """
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = StructType([*kept, *StructType.fromDDL(fields).fields])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            old = [batch.column(batch.schema.names.index(f.name)) for f in kept]
            new = [pa.array(c, target.field(len(old) + i).type) for i, c in enumerate(fn(texts))]
            columns = [c.cast(target.field(i).type) for i, c in enumerate(old)] + new
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def in_pieces(texts: list[str], most: int):
    """Runs of texts of at most ``most`` characters together, or of one longer text."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, most: int, most_bytes: int) -> list:
    """Rows (text, label) of at most ``most`` labelled documents of at most ``most_bytes`` bytes each.

    ``labels`` has doc_id; ``label`` aggregates its labels of one.  The labels are chosen first, by a hash of doc_id, so
    what is broadcast to the texts has ``most`` rows at any size of the tables.
    """
    chosen = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(label.alias("label")).filter("label IS NOT NULL")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = materialize(chosen.orderBy(*order).limit(most), "chosen-labels")
    text = docs.select("doc_id", text_or_empty().alias("text")).filter(F.octet_length("text") <= most_bytes)
    return text.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(most).select("text", "label").collect()


def bit_map(keys: DataFrame, key: str):
    """A broadcast map in which the bit of every key is set; bits are the keys modulo their number, a power of two."""
    spark = keys.sparkSession
    bits = LEAST_BITS
    while bits < min(16 * keys.count(), MOST_BITS):
        bits *= 2
    at = keys.select((F.pmod(F.col(key), F.lit(bits)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        some = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * some.size :][: some.size] = some
    return spark.sparkContext.broadcast(out)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(8 * bits.size - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
