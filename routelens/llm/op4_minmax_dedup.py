"""Near-duplicate groups by min-max hashing.

A document is its set of word shingles.  Under each permutation of the hashes both the smallest and the
greatest value of the set are kept, so a signature takes half as many permutations as values.  Bands of
the signature deal documents into buckets; a link of similarity 0.8 has no bucket in common with
probability (1 - 0.8**4)**32, about 5 in 10**8.

Documents of one set are one class, and only classes are compared.  Buckets of the same classes are kept
once.  In a bucket the full sets are compared: all with all in small ones; larger ones are cut into blocks
of bounded size, and the first block is compared with itself and with each other one, so every set travels
about twice.  A group gives links that span its connected classes, never all pairs.  Only classes of a
large bucket that are then in different components can still add something: they are cut into blocks
anew, whole blocks of one component where it is large, and compared between blocks of different
components.  Components of all links are the result, so no pair of a bucket is left out unless it is
connected already, and a bucket of thousands of near copies costs in proportion.

Words are known by 64 bits, those of 32 bytes or more by 64 bits of a BLAKE2 digest, shingles by a hash of
their words'.

Null and empty texts, and texts without words, have no shingles and are linked with nothing.  Rows that
repeat a doc_id are one document in the links.  Rows with a null doc_id are one document for each text,
greater than all others; a component of nothing else has a null component_id.  Other columns are not
read by the groups; the filter keeps them.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bit_map, documents, has_bit, in_pieces, text_or_empty, with_text_columns
from routelens.llm.components import components
from routelens.llm.words import distinct, mix, shingles, word_hashes
from routelens.plans.shared import materialize

PERMUTATIONS, BAND = 64, 4
SHINGLE, PERCENT = 4, 80
#: A block holds about so many shingles and classes, and a group two blocks.
BLOCK_SHINGLES, BLOCK_CLASSES = 250_000, 500
CHARS_AT_ONCE = 2_000_000
DIGEST_FROM = 32
#: Documents without a doc_id go by a number from here on, made of their text.
NO_ID = 2**62
_FACTORS = np.random.default_rng(7).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, ascending."""
    out = []
    for run in in_pieces(texts, CHARS_AT_ONCE):
        values, starts = distinct(*shingles(*word_hashes(run, DIGEST_FROM), n))
        out += [values[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return out


def set_digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if values.size else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set that is not empty: smallest and greatest value under each permutation."""
    sets = [s for s in sets if s.size]
    out = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint32)
    if sets:
        values, starts = np.concatenate(sets), np.cumsum([0, *(s.size for s in sets[:-1])])
        for i, factor in enumerate(_FACTORS):
            permuted = (values * factor) >> np.uint64(32)
            out[:, 2 * i], out[:, 2 * i + 1] = np.minimum.reduceat(permuted, starts), np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; keys of different bands differ."""
    keys = np.zeros((signature.shape[0], signature.shape[1] // BAND), np.uint64) + np.arange(1, signature.shape[1] // BAND + 1, dtype=np.uint64)
    for i in range(BAND):
        keys = mix(keys * np.uint64(3) + signature[:, i::BAND])
    return keys.view(np.int64)


def _described(n: int):
    def describe(texts: list[str]) -> list:
        size, digest, keys = [], [], []
        for run in in_pieces(texts, CHARS_AT_ONCE):
            sets = shingle_sets(run, n)
            rows = iter(band_keys(signatures(sets)).tolist())
            size += [s.size for s in sets]
            digest += [set_digest(s) for s in sets]
            keys += [next(rows) if s.size else None for s in sets]
        return [size, digest, keys]

    return describe


def spanning_links(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever sets are alike enough: places a, b of ``sets``, a tree for each component.

    With ``split``, only sets before that place are compared with those from it on.
    """
    roots = list(range(len(sets)))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    size = np.array([s.size for s in sets])
    local = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts = np.concatenate(([0], np.cumsum(size)))
    has, out = np.zeros(int(local.max()) + 1, np.uint8), []
    for x in range(len(sets) if split is None else split):
        first = max(x + 1, split or 0)
        if first >= len(sets):
            break
        mine = local[starts[x] : starts[x + 1]]
        has[mine] = 1
        both = np.add.reduceat(has[local[starts[first] :]], starts[first:-1] - starts[first], dtype=np.int64)
        has[mine] = 0
        alike = 100 * both >= percent * (size[x] + size[first:] - both)
        for y in (np.flatnonzero(alike) + first).tolist():
            a, b = root(x), root(y)
            if a != b:
                roots[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


LINK, PIVOT, OTHER = 0, 1, 2
_FOUND = "key bigint, a bigint, b bigint, n bigint, kind int"


def _links_of_group(percent: int):
    """A group's links a-b; and of a large bucket, for each pivot a and each other class a, what it hangs together with.

    That is b: a pivot, for a class of another block that is connected to one within the group, or else the class itself.
    """

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("side", "class_id", "shingles")), strict=True))
        sets = [np.frombuffer(s, np.uint64) for _, _, s in rows]
        split = sum(side == 0 for side, _, _ in rows)
        if split == len(sets) and "part" in group.column_names and group["part"][0].as_py():
            sets, rows, split = [], [], 0  # pivots that no other class came to
        found = spanning_links(sets, percent, split if split < len(sets) else None) if sets else []
        out = [(rows[x][1], rows[y][1], 0, LINK) for x, y in found]
        if group["large"][0].as_py():
            roots = list(range(len(rows)))
            for x, y in found:  # pivots come first, so the least place is a pivot if there is one
                one, two = sorted((roots[x], roots[y]))
                roots = [one if r == two else r for r in roots]
            first = split if split < len(sets) else 0  # a pivot's own group has pivots only
            kind = OTHER if first or not split else PIVOT
            for i in range(first, len(rows)):
                root = roots[i] if kind == PIVOT or roots[i] < split else i
                out.append((rows[i][1], rows[root][1], sets[i].size, kind))
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.Table.from_arrays([pa.array([group["key"][0].as_py()] * len(out), pa.int64()), *columns], names=["key", "a", "b", "n", "kind"])

    return compare


def _keys_in(wanted):
    """digest, id, keys -> the same with those keys only whose bit is set, of rows that have one."""

    def run(batches):
        for batch in batches:
            keys = batch.column(2)
            values, sizes = keys.flatten().to_numpy(zero_copy_only=False), keys.value_lengths().to_numpy(zero_copy_only=False)
            inside = has_bit(wanted.value, values)
            row = np.repeat(np.arange(sizes.size), sizes)[inside]
            count = np.bincount(row, minlength=sizes.size)
            offsets = np.concatenate(([0], np.cumsum(count[count > 0]))).astype(np.int32)
            kept = pa.array(count > 0)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[inside]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), lists], names=["digest", "id", "keys"])

    return run


def _id(docs: DataFrame) -> Column:
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(docs["text"], F.lit(""))), 2).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(docs["doc_id"].cast("long"), of_text)


def _rooted(docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """doc_id, id, n_shingles, root for every row of ``docs``: root is the least id that its id reaches."""
    text = docs.select("doc_id", _id(docs).alias("id"), text_or_empty().alias("text"))
    rows = with_text_columns(text, _described(n), "n_shingles bigint, digest binary, keys array<bigint>")
    rows = materialize(rows, "signatures")

    # The class of a set is its smallest document.
    sets = rows.filter("digest IS NOT NULL")
    classes = sets.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    first = sets.join(classes, (sets["digest"] == classes["digest"]) & (F.col("id") == F.col("class_id")))
    keyed = first.select("class_id", "n_shingles", F.explode("keys").alias("key"))

    # Buckets of two classes or more, each set of classes once.
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("members"),
        F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("sum"),
        F.sum(F.hash("class_id").cast("long")).alias("sum2"),
    )
    buckets = buckets.filter("members > 1").groupBy("members", "shingles", "sum", "sum2").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("shingles") / block, F.col("members") / BLOCK_CLASSES)).cast("int")
    buckets = materialize(buckets.select("key", blocks.alias("blocks")), "buckets")
    # Only keys of such buckets meet them; a bit map rules out nearly all others before anything is shuffled.
    shared = sets.select("digest", "id", "keys").mapInArrow(_keys_in(bit_map(buckets, "key")), "digest binary, id bigint, keys array<bigint>")
    first = shared.join(classes, (shared["digest"] == classes["digest"]) & (F.col("id") == F.col("class_id")))
    keyed = first.select("class_id", F.explode("keys").alias("key"))
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    dealt = keyed.join(buckets, "key").select("key", "class_id", "blocks", own.alias("own"))
    # The first block meets all blocks of its bucket, the others it alone.
    to = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    side = F.when(F.col("own") == 0, 0).otherwise(1).alias("side")
    members = dealt.select("key", F.explode(to).alias("part"), "class_id", side, (F.col("blocks") > 1).alias("large"))
    members = materialize(members, "members")

    # Full sets of the classes that share a bucket, and the links of each group.
    wanted = members.select("class_id").distinct().join(classes, "class_id").select("digest", "class_id")
    full = _full_sets(docs, materialize(wanted, "wanted"), n)
    large = not buckets.filter("blocks > 1").isEmpty()
    full = materialize(full, "full-sets") if large else full
    found = members.join(full, "class_id").groupBy("key", "part").applyInArrow(_links_of_group(percent), _FOUND)
    found = materialize(found, "near-links")
    links = found.filter(F.col("kind") == LINK).select("a", "b")
    across = _across(found, block) if large else None
    if across is not None:
        more = across.join(full, "class_id").groupBy("key").applyInArrow(_links_of_group(percent), _FOUND)
        links = links.unionByName(materialize(more, "links-across").select("a", "b"))
    roots = components(links).withColumnRenamed("node", "class_id")

    labelled = classes.join(roots, "class_id", "left")
    labelled = materialize(labelled.select(F.col("digest").alias("of"), F.coalesce("root", "class_id").alias("root")), "labelled")
    out = rows.join(labelled, rows["digest"] == labelled["of"], "left")
    return out.select("doc_id", "id", "n_shingles", F.coalesce("root", "id").alias("root"))


def _across(found: DataFrame, block: int) -> DataFrame | None:
    """key, class_id, side, large: pairs of blocks, one key each, of classes of one bucket that do not all hang together yet."""
    pivots = found.filter(F.col("kind") == PIVOT).select(F.col("key").alias("_key"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    rows = found.filter(F.col("kind") == OTHER).join(pivots, (F.col("key") == F.col("_key")) & (F.col("b") == F.col("_a")), "left")
    rows = rows.select("key", F.col("a").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce("_b", "b").alias("root"))
    rows = materialize(rows, "rooted-members")
    share = F.greatest(F.sum("n_shingles") / block, F.count("*") / BLOCK_CLASSES)
    sizes = materialize(rows.groupBy("key", "root").agg(share.alias("share")), "component-sizes")
    mixed = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("share") < 1, F.col("share"))).alias("rest")).filter("roots > 1")
    mixed = materialize(mixed, "mixed-buckets")
    if mixed.isEmpty():
        return None
    sizes = sizes.join(mixed, "key").select(
        F.col("key").alias("_key"), F.col("root").alias("_root"), (F.col("share") >= 1).alias("whole"),
        F.when(F.col("share") >= 1, F.ceil("share")).otherwise(F.greatest(F.ceil("rest"), F.lit(1))).alias("blocks"),
    )
    placed = rows.join(materialize(sizes, "component-blocks"), (F.col("key") == F.col("_key")) & (F.col("root") == F.col("_root")))
    of = F.when(F.col("whole"), F.col("root")).otherwise(0).alias("of")
    nth = F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("class_id")).otherwise(F.col("root"))), F.col("blocks")).alias("nth")
    placed = materialize(placed.select("class_id", F.struct("key", "whole", of, nth).alias("part")), "placed-members")

    parts = materialize(placed.select("part").distinct(), "parts")
    one, two = (parts.select(F.col("part.key").alias("key"), F.col("part").alias(c)) for c in ("one", "two"))
    of_one = F.col("one.whole") & F.col("two.whole") & (F.col("one.of") == F.col("two.of"))
    pairs = one.join(two, "key").filter((F.col("one") <= F.col("two")) & ~of_one).drop("key")
    pairs = materialize(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs-of-parts")
    first = placed.join(pairs, F.col("part") == F.col("one")).select(F.col("pair").alias("key"), "class_id", F.lit(0).alias("side"))
    second = placed.join(pairs.filter("one <> two"), F.col("part") == F.col("two"))
    second = second.select(F.col("pair").alias("key"), "class_id", F.lit(1).alias("side"))
    return first.unionByName(second).withColumn("large", F.lit(False))


def near_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    out = _rooted(docs, n, percent, block)
    component = F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, (F.col("id") == F.col("root")).alias("kept"))


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class_id, shingles for the wanted classes, made again from a text of each class."""
    text = docs.select(_id(docs).alias("class_id"), text_or_empty().alias("text"))
    text = text.join(wanted.hint("merge"), "class_id")  # planned alike at every size: the wanted grow with the texts

    def make(texts: list[str]) -> list:
        sets = shingle_sets(texts, n)
        return [[set_digest(s) for s in sets], [s.tobytes() for s in sets]]

    out = with_text_columns(text, make, "own binary, shingles binary")
    return out.filter("own = digest").select("class_id", "shingles")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: the least document of each component."""
    goes = _rooted(docs, n, percent, BLOCK_SHINGLES).filter("id <> root").select(F.col("id").alias("_goes"))
    goes = materialize(goes, "near-copies")
    return docs.join(goes, _id(docs) == goes["_goes"], "left_anti")


def op4_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
