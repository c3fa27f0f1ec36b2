"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

On unit vectors a cosine of 0.95 is a distance of 0.316.  A hash is the cell of width ``CELLS`` times that distance in which a
projection on a Gaussian direction, shifted at random, falls; a table's bucket is ``k`` such cells.  Cells of two vectors agree
with a known probability of their distance, so ``plan_tables`` chooses k by the number of vectors, to leave about ``ROOM``
unrelated ones in a bucket, and the number of tables for a recall of ``RECALL`` at the threshold itself (closer pairs are missed
far less often).  Directions and vectors are rounded to integers whose products are exact, so every task makes the same keys.

Equal vectors are one class with a number of copies, and only classes are hashed.  A bucket's members first meet as sketches: 16
orthonormal projections in a byte each, whose distance, less the rounding, never exceeds the true one, so members without a near
sketch can be dropped at no loss.  The vectors of the others are then joined in and compared exactly, in double precision.
Buckets beyond ``BLOCK`` members are cut into blocks and every two blocks are compared in a group of their own, so no group is
unbounded.  A pair counts only in the first table that its vectors share, and a group gives link counts per class and links that
span its connected classes, never all pairs.

Odd rows.  Null vectors, zero or empty ones, and those with a null or non-finite component link with nothing.  Vectors of unequal
dimension are never compared.  Rows that repeat a vec_id are vectors of their own, and so are rows without vec_id; a component
goes by its least vec_id that is not null, and by null if it has none.  Empty tables give no rows; other columns are not read.
"""

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.components import components
from routelens.plans.shared import broadcast_if_small, materialize

COSINE = 0.95
CELLS, ROOM, RECALL = 8.0, 64, 0.995
SKETCH, STEPS = 16, 127
BLOCK = 2000
FINE, DIRECTION = 2.0**20, 2.0**12


def agreement(ratio: float) -> float:
    """Probability that the cells of two vectors agree, where a cell is ``ratio`` times as wide as their distance."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan_tables(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """Cells of a bucket and number of tables for that many vectors."""
    near, far = agreement(CELLS), agreement(CELLS * math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows / ROOM, 1)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, alike in every task: sums run in order, whatever rows come together."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])


@functools.lru_cache(16)
def _directions(dim: int, k: int, tables: int, cosine: float) -> tuple:
    draw = np.random.default_rng([20240612, dim])
    width = CELLS * math.sqrt(2 - 2 * cosine) * FINE * DIRECTION
    towards = np.rint(draw.standard_normal((dim, k * tables)) * DIRECTION)
    shift = np.floor(draw.random(k * tables) * width)
    odd = draw.integers(0, 2**63, k * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return towards, shift, width, odd


def bucket_keys(unit: np.ndarray, k: int, tables: int, cosine: float) -> np.ndarray:
    """A row per vector: its bucket in each table, with the table's number in the upper half."""
    towards, shift, width, odd = _directions(unit.shape[1], k, tables, cosine)
    cells = np.floor((np.rint(unit * FINE) @ towards + shift) / width).astype(np.int64).view(np.uint64)
    mixed = (cells * odd).reshape(len(unit), tables, k).sum(axis=2, dtype=np.uint64) >> np.uint64(32)
    return (mixed | (np.arange(tables, dtype=np.uint64) << np.uint64(32))).view(np.int64)


@functools.lru_cache(16)
def _frame(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([99, dim]).standard_normal((dim, min(dim, SKETCH))))[0]


def sketches(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit @ _frame(unit.shape[1]) * STEPS).astype(np.int8)


def sketch_reach(dim: int, cosine: float) -> float:
    """Sketches of vectors of that cosine or more lie no farther apart, in steps."""
    return math.sqrt(2 - 2 * cosine) * STEPS + math.sqrt(min(dim, SKETCH)) + 1e-6


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _digests(batches):
    """vec_id, embedding -> vec_id, digest: a digest of the components, or null for a vector that links with nothing."""
    for batch in batches:
        digests = []
        for x in batch.column(1):
            x = np.array([np.nan if v is None else v for v in x.as_py()] if x.is_valid else [], np.float64)
            fits = np.isfinite(x).all() and x.any()
            digests.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if fits else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(1)], names=["vec_id", "digest", "embedding"])


def _keyed(k: int, tables: int, cosine: float):
    """class_id, dim, embedding -> class_id, dim, keys, sketch."""

    def run(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                unit = units(_stack(some["embedding"], dim))
                keys = pa.array(list(bucket_keys(unit, k, tables, cosine)), pa.list_(pa.int64()))
                sketch = pa.array([s.tobytes() for s in sketches(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([some["class_id"], some["dim"], keys, sketch], names=["class_id", "dim", "keys", "sketch"])

    return run


_GROUP = ["bucket", "dim", "one", "two"]


def _whole_groups(batches):
    """Tables that end with a whole group, of rows sorted by group, and where each group begins (and the last ends)."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in _GROUP:
            values = table[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.concatenate(([0], np.flatnonzero(new), [table.num_rows]))

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 2 * BLOCK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = starts(table)
        if at.size > 2:  # the last group may go on
            yield table.slice(0, int(at[-2])).combine_chunks(), at[:-1]
        held = table.slice(int(at[-2])).to_batches()
        size = table.num_rows - int(at[-2])
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _near_members(cosine: float):
    """Of every group the members whose sketch is near that of a member it is to be compared with."""

    def run(batches):
        for table, at in _whole_groups(batches):
            dims, side = table["dim"].to_numpy(), table["side"].to_numpy()
            data, keep = table["sketch"].to_pylist(), np.zeros(table.num_rows, bool)
            apart = table["one"].to_numpy() != table["two"].to_numpy()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                s = np.frombuffer(b"".join(data[a:b]), np.int8).reshape(b - a, -1).astype(np.float32)
                split = int((side[a:b] == 0).sum()) if apart[a] else 0
                left, right = (s[:split], s[split:]) if apart[a] else (s, s)
                square = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)
                near = square <= sketch_reach(int(dims[a]), cosine) ** 2
                if apart[a]:
                    keep[a:b] = np.concatenate((near.any(axis=1), near.any(axis=0)))
                else:
                    np.fill_diagonal(near, False)
                    keep[a:b] = near.any(axis=1)
            found = table.select([*_GROUP, "side", "class_id"]).filter(pa.array(keep))
            yield from found.to_batches()

    return run


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links i-j of places below ``n`` that connect whatever all of them do."""
    roots, out = np.arange(n), []
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), i.size], strict=True):
        x, own = int(i[a]), roots[i[a]]
        others, first = np.unique(roots[j[a:b]], return_index=True)
        for root, y in zip(others.tolist(), j[a:b][first].tolist(), strict=True):
            if root != own:
                out.append((x, y))
        roots[np.isin(roots, others)] = own
    return out


def _exact_links(k: int, tables: int, cosine: float):
    """Groups of members with their vectors -> rows (a, null, links of a) and (a, b, null) for links that span."""

    def run(batches):
        for table, at in _whole_groups(batches):
            bucket, dims, side, ids, copies = (table[c].to_numpy() for c in ("bucket", "dim", "side", "class_id", "copies"))
            apart = table["one"].to_numpy() != table["two"].to_numpy()
            vectors, ends, links, counts = table["embedding"].chunk(0), ([], []), ([], []), None
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                unit = units(_stack(vectors.slice(a, b - a), int(dims[a])))
                split = int((side[a:b] == 0).sum()) if apart[a] else 0
                if apart[a]:
                    i, j = np.nonzero(unit[:split] @ unit[split:].T >= cosine)
                    j += split
                else:
                    i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
                nth = int(bucket[a]) >> 32
                if nth and i.size:  # pairs that share no earlier bucket
                    keys = bucket_keys(unit, k, tables, cosine)
                    for t in range(nth):
                        new = keys[i, t] != keys[j, t]
                        i, j = i[new], j[new]
                if i.size:
                    own = ids[a:b]
                    counts = np.bincount(i, copies[a:b][j], b - a) + np.bincount(j, copies[a:b][i], b - a)
                    some = np.flatnonzero(counts)
                    links[0].append(own[some])
                    links[1].append(counts[some].astype(np.int64))
                    for x, y in spanning(b - a, i, j):
                        ends[0].append(own[x])
                        ends[1].append(own[y])
            linked, numbers = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in links)
            columns = [
                pa.array(np.concatenate((linked, np.array(ends[0], np.int64)))),
                pa.array([None] * linked.size + [int(x) for x in ends[1]], pa.int64()),
                pa.array([*numbers.tolist(), *[None] * len(ends[0])], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding)."""
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = materialize(rows.mapInArrow(_digests, f"vec_id bigint, digest binary, embedding {kind}"), "digests")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("class_id", F.monotonically_increasing_id()), "classes")

    k, tables = plan_tables(classes.count(), cosine)
    keyed = classes.select("class_id", "dim", "embedding").mapInArrow(_keyed(k, tables, cosine), "class_id bigint, dim int, keys array<bigint>, sketch binary")
    entries = materialize(keyed, "keys").withColumn("bucket", F.explode("keys")).drop("keys")
    large = entries.groupBy("bucket", "dim").count().filter(F.col("count") > block)
    large = materialize(large.select("bucket", "dim", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    dealt = entries.join(broadcast_if_small(large), ["bucket", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    dealt = dealt.select("bucket", "dim", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side, "class_id", "sketch")

    def by_group(df: DataFrame) -> DataFrame:
        return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "side", "class_id")

    members = by_group(dealt).mapInArrow(_near_members(cosine), "bucket bigint, dim int, one int, two int, side int, class_id bigint")
    members = materialize(members, "near-members").join(classes.select("class_id", "embedding", "copies"), "class_id")
    found = by_group(members).mapInArrow(_exact_links(k, tables, cosine), "a bigint, b bigint, n bigint")
    found = materialize(found, "near-links")

    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    roots = materialize(components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class_id"), "roots")
    least = classes.select("class_id", "least").join(roots, "class_id").groupBy("root").agg(F.min("least").alias("of_all"))
    roots = roots.join(least, "root").select("class_id", "of_all")
    out = classes.select("digest", "class_id", "copies", "least").join(counts, "class_id", "left").join(roots, "class_id", "left")
    out = out.select(
        F.col("digest").alias("of"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("of_all", "least").alias("component_id"),
        F.lit(True).alias("valid"),
    )
    out = materialize(out, "class-links")
    out = rows.select("vec_id", "digest").join(broadcast_if_small(out), F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_stable_cosines(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
