"""Hard negatives for contrastive training, from inner products of packed integers.

Components are scaled and floored, so scores are integers.  Rows are laid out in blocks, component by component.  To score a
block, the biased components of its rows become fields of one wide integer per component; an anchor multiplies each of these
integers by its own component, once for all rows of the block, and adds the products.  The bias makes every field of the sum
non-negative and the field width holds its greatest possible value, so no field runs into the next and each is an exact score.

Anchors meet rows block by block, never row by row: blocks of anchors are broadcast in rounds of ``ANCHOR_BYTES`` at most, joined
to the blocks of rows by dimension, and each pair of blocks gives a few rows per anchor.  A first pass over the blocks finds the
positives, a second the negatives within the score band of each distinct positive score.  Rows are never shuffled; only the best
few per (anchor, task) are.  The work is anchors times rows, as the search is exact.

Odd rows.  A row takes no part if its vec_id, label or vector is null, or if a component is null, not finite, or too large for
exact scores (2**24 after scaling, or 2**32 in the sum of all).  Only rows of the anchor's dimension are compared with it; the
empty vector has dimension 0 and score 0.  Rows that repeat vec_id, label and components are one row; rows of one vec_id that
differ are rows of their own, but never positives or negatives of an anchor of that vec_id, and where such rows score alike
under one label they count once.  Empty tables, and anchors without positives or without fitting negatives, give no rows.
Other columns are not read.
"""

import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.plans.shared import materialize

SCALE, MOST, MOST_SUM = 256, 2**24, 2**32
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows of a block, anchors of a block, and bytes of anchors that are broadcast together.
BLOCK_ROWS, BLOCK_ANCHORS, ANCHOR_BYTES = 2048, 512, 32 << 20


def scores(anchors: np.ndarray, fields: np.ndarray, bias: int) -> np.ndarray:
    """Inner products of each anchor (a row) with each candidate, whose components plus ``bias`` are a column of ``fields``."""
    n = fields.shape[1]
    anchors = anchors.astype(np.int64)
    heavy = int(np.abs(anchors).sum(axis=1, dtype=np.int64).max(initial=0))
    width = 4 if 4 * bias * heavy < 2**32 else 8
    kind = np.dtype(f"<u{width}")
    packed = [int.from_bytes(row.tobytes(), "little") for row in fields.astype(kind)]
    ones = int.from_bytes(np.ones(n, kind).tobytes(), "little")
    out = np.zeros((len(anchors), n), np.int64)
    for i, anchor in enumerate(anchors.tolist()):
        lift = 2 * bias * sum(map(abs, anchor))  # no biased component exceeds twice the bias, so no field of the sum is negative
        total = sum(map(operator.mul, anchor, packed), ones * lift)
        found = np.frombuffer(total.to_bytes(n * width, "little"), kind).astype(np.uint64)
        out[i] = (found - np.uint64(lift)).view(np.int64) - bias * sum(anchor)
    return out


def scaled(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, x: the rows that take part, with integer components."""
    value = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), value.alias("x"))
    wrong = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= MOST))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(~wrong).filter(total < MOST_SUM)
    return rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda v: F.floor(v).cast("int")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(len(column), dim)


def _by_dimension(batches, most: int):
    """Tables of at most ``most`` rows of one dimension, of whatever rows a task has."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim in np.unique(batch["dim"].to_numpy()).tolist():
            held.setdefault(dim, []).append(pa.Table.from_batches([batch]).filter(pa.compute.equal(batch["dim"], dim)))
            while sum(t.num_rows for t in held[dim]) >= most:
                whole = pa.concat_tables(held[dim])
                yield dim, whole.slice(0, most).combine_chunks()
                held[dim] = [whole.slice(most)]
    for dim, tables in held.items():
        if sum(t.num_rows for t in tables):
            yield dim, pa.concat_tables(tables).combine_chunks()


def _row_blocks(most: int):
    def run(batches):
        for dim, table in _by_dimension(batches, most):
            x = _matrix(table["x"].chunk(0), dim)
            bias = int(np.abs(x).max(initial=0))
            fields = np.ascontiguousarray(x.T + np.int32(bias)).astype("<u4")
            ids, labels = (table[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
            columns = [pa.array([v], t) for v, t in ((dim, pa.int32()), (bias, pa.int64()), (ids, pa.binary()), (labels, pa.binary()), (fields.tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "bias", "ids", "labels", "fields"])

    return run


def _anchor_blocks(most: int):
    """no, vec_id, label, dim, x, bands -> blocks of anchors; an anchor's bands are its distinct positive scores."""

    def run(batches):
        for dim, table in _by_dimension(batches, most):
            nos, ids, labels = (table[c].to_numpy().astype("<i8").tobytes() for c in ("no", "vec_id", "label"))
            x, bands = _matrix(table["x"].chunk(0), dim).tobytes(), table["bands"].to_pylist()
            columns = [pa.array([v], t) for v, t in ((dim, pa.int32()), (nos, pa.binary()), (ids, pa.binary()), (labels, pa.binary()), (x, pa.binary()), (bands, pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "nos", "anchor_ids", "anchor_labels", "anchors", "bands"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, which: np.ndarray, k: int, repeats: bool) -> np.ndarray:
    """Places of the first ``k`` of ``which`` by falling score, then id; equal (score, id) count once."""
    if which.size > 4 * k and not repeats:
        which = which[score[which] >= np.partition(score[which], which.size - k)[which.size - k]]
    order = which[np.lexsort((ids[which], -score[which]))]
    if repeats and order.size:
        new = (np.diff(score[order], prepend=score[order[0]] + 1) != 0) | (np.diff(ids[order], prepend=ids[order[0]]) != 0)
        order = order[new]
    return order[:k]


def _pairs_scored(of_anchor):
    """For each pair of a row block and an anchor block the rows (no, band, id, score) that ``of_anchor`` chooses."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
                nos, anchor_ids, anchor_labels = (np.frombuffer(row[c], "<i8") for c in ("nos", "anchor_ids", "anchor_labels"))
                fields = np.frombuffer(row["fields"], "<u4").reshape(row["dim"], ids.size)
                anchors = np.frombuffer(row["anchors"], "<i4").reshape(nos.size, row["dim"])
                found = scores(anchors, fields, row["bias"])
                out, repeats = ([], [], [], []), np.unique(ids).size < ids.size
                for i, bands in enumerate(row["bands"]):
                    same = labels == anchor_labels[i]
                    for band, places in of_anchor(found[i], ids, same, ids != anchor_ids[i], bands, repeats):
                        for column, values in zip(out, (np.full(places.size, nos[i]), np.full(places.size, band), ids[places], found[i][places]), strict=True):
                            column.append(values)
                columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
                yield pa.RecordBatch.from_arrays(columns, names=["no", "band", "id", "score"])

    return run


def _positives(k: int):
    def choose(score, ids, same, other, _, repeats):
        yield 0, _best(score, ids, np.flatnonzero(same & other), k, repeats)

    return choose


def _negatives(k: int, low: int, high: int):
    def choose(score, ids, same, other, bands, repeats):
        for band in bands:
            fits = ~same & other & (low * band <= 100 * score) & (100 * score <= high * band)
            yield band, _best(score, ids, np.flatnonzero(fits), k, repeats)

    return choose


def _searched(blocks: DataFrame, anchors: DataFrame, rounds: int, of_anchor, k: int, label: str) -> DataFrame:
    """no, band, id, score, rank: the first ``k`` per (no, band) over all blocks of rows."""
    out = None
    for i in range(rounds):
        some = materialize(anchors.filter(F.pmod(F.hash("no"), F.lit(rounds)) == i).mapInArrow(_anchor_blocks(BLOCK_ANCHORS), _ANCHOR_BLOCK), f"{label}-anchors")
        scored = blocks.join(F.broadcast(some), "dim").mapInArrow(_pairs_scored(of_anchor), "no bigint, band bigint, id bigint, score bigint")
        order = Window.partitionBy("no", "band").orderBy(F.desc("score"), "id")
        best = scored.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).distinct()
        best = materialize(best, label)
        out = best if out is None else out.unionByName(best)
    return out


_ANCHOR_BLOCK = "dim int, nos binary, anchor_ids binary, anchor_labels binary, anchors binary, bands array<array<bigint>>"


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_rows: int = BLOCK_ROWS, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label, embedding; ``is_anchor`` chooses anchors by vec_id and label.  Negatives score from ``low`` to
    ``high`` percent of the positive.
    """
    rows = scaled(rows)
    anchors = rows.filter(is_anchor).distinct().withColumn("no", F.monotonically_increasing_id())
    anchors = materialize(anchors, "anchors")
    size = anchors.agg(F.sum(4 * F.col("dim") + 24).alias("size")).first()["size"] or 0
    rounds = max(1, -(-size // anchor_bytes))
    blocks = materialize(rows.mapInArrow(_row_blocks(block_rows), "dim int, bias bigint, ids binary, labels binary, fields binary"), "row-blocks")

    none = F.array().cast("array<bigint>")
    best = _searched(blocks, anchors.withColumn("bands", none), rounds, _positives(positives), positives, "positives")
    best = best.select("no", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    bands = best.groupBy(F.col("no").alias("of")).agg(F.collect_set("positive_score").alias("bands"))  # ``positives`` at most
    with_bands = materialize(anchors.join(bands, F.col("no") == F.col("of")).drop("of"), "anchors-with-bands")
    worst = _searched(blocks, with_bands, rounds, _negatives(negatives, low, high), negatives, "negatives")
    worst = worst.select(F.col("no").alias("_no"), F.col("band").alias("_band"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    of = anchors.select(F.col("no").alias("_of"), F.col("vec_id").alias("anchor_id"))
    out = best.join(worst, (best["no"] == worst["_no"]) & (best["positive_score"] == worst["_band"])).join(of, F.col("no") == F.col("_of"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_kronecker_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH valid AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id AS id, c.label AS label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM valid a JOIN valid c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x)
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10
"""
