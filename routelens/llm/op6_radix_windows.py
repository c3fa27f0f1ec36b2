"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Two windows of 400 bytes are equal exactly when their suffixes agree through 400 bytes, so suffixes need
order only through that depth, and groups that are still equal there are the repeated windows.  Sorting
every suffix would move the text hundreds of times over, so suffixes are sorted in bundles that no
equality can cross:

* The owner of a window is the place, among its first 300, whose 16 bytes hash least.  Equal windows have
  owners at the same place in them, so a bundle is all windows of one owner: a run of neighbours.
* First pass: the digit is a 64-bit name of the bytes that all windows of an owner hold.  Digits are counted,
  and a bit map of those that repeat goes to the tasks.  Bundles whose bit is not set are done.
* Second pass: the digit is a 128-bit BLAKE2 digest of all bytes of the bundle.  Where bundles of one first
  digit agree in it too, all their windows are repeated.
* Last passes, only within first digits under which bundles differ, one bundle for each second digit: the
  bundles' bytes meet in a task that sorts their windows eight bytes at a time, most significant first.  Names
  of windows only tell beforehand which cannot be equal.  Where more than ``MOST_KINDS`` bundles differ under
  a first digit, each of their windows becomes a row and groups are counted by 128-bit digests instead.

So no equality rests on a name: bit maps and names that collide only send more bundles on.  Bit maps are
bounded (``common.MOST_BITS``) and computed from counts over all rows.

Groups are counted map-side before they are shuffled, and their members are found by joins; keys that
hold a noticeable share of all members are broadcast, of which there are few by their definition.  A
document's own places are all that meets in one row.  Texts travel compressed to their places, and only
those that lose something or have a bundle to be opened.

Null text counts as empty.  Texts shorter than a window lose nothing.  Rows that repeat doc_id and text
are repeats of each other, as any others.  Empty tables give no rows; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bit_map, documents, has_bit, text_or_empty
from routelens.llm.words import mix
from routelens.plans.shared import materialize

WINDOW, OWNERS, GRAM = 400, 300, 16
MOST_KINDS = 4096
#: Bytes that a task works on together; each takes some hundred bytes of arrays.
BYTES_AT_ONCE = 1 << 18
#: A key with more than this share of the rows of a join is broadcast; there are at most as many.
HOT = 2048
DIGIT = 8
_BYTE = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_KEY = ["doc_id", "text_hash"]


class RunNames:
    """Names of byte runs of a buffer: a polynomial modulo 2**64, mixed.  Equal runs have equal names; unequal ones may."""

    powers = [np.zeros(0, np.uint64)] * 2

    def __init__(self, raw: np.ndarray):
        if self.powers[0].size <= raw.size:
            for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                p = np.full((raw.size | 0xFFFF) + 1, base, np.uint64)
                p[0] = 1
                self.powers[i] = np.cumprod(p, out=p)
        power, self.inverse = self.powers
        self.sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: raw.size], out=self.sums[1:])

    def names(self, first, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.inverse[: self.sums.size - n])


def bundles(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, owners: int = OWNERS, gram: int = GRAM) -> tuple:
    """Of every bundle of texts laid end to end: text, owner, first and last window, first digit.

    Places count from the start of the bundle's text.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if raw.size < window:
        return none
    run = RunNames(raw)
    places = raw.size - gram + 1
    bits = np.uint64(int(places).bit_length())
    least = (run.grams(gram) >> bits << bits) | np.arange(places, dtype=np.uint64)
    width = 1
    while width < owners:  # the least over twice as many places, leftmost of equals
        step = min(width, owners - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(ends.size), np.maximum(ends - first - window + 1, 0))
    if not text.size:
        return none
    counts = np.bincount(text, minlength=ends.size)
    start = np.arange(text.size) + (first - np.concatenate(([0], np.cumsum(counts)[:-1])))[text]
    owner = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])))
    lo, hi = start[new], start[np.concatenate((new[1:], [True]))]
    owner, text = owner[new], text[new]
    one = run.names(owner, owner + window - owners + 1)
    at = first[text]
    return text, owner - at, lo - at, hi - at, one.view(np.int64)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, i]) for i in (0, 1)]


def _utf8(column: pa.Array):
    """The bytes of each text of a column, one at a time."""
    return (text.as_buffer().to_pybytes() for text in column)


def _sliced(batches, size: int = BYTES_AT_ONCE):
    """Batches cut into runs of rows of about that many bytes."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bundled(batches, column: int, window: int, owners: int, gram: int):
    """Texts of batches in pieces: batch, rows and places of its parts of texts, their bytes, and its bundles."""

    def piece(batch, parts: list) -> tuple:
        raw, ends = b"".join(d for _, _, d in parts), np.cumsum([len(d) for _, _, d in parts])
        return batch, parts, raw, ends, bundles(np.frombuffer(raw, np.uint8), ends, window, owners, gram)

    for batch in batches:
        parts, size = [], 0
        for row, data in enumerate(_utf8(batch.column(column))):
            # Parts of a text overlap, so that each window is whole in one of them.
            for at in range(0, max(len(data) - window + 1, 0), BYTES_AT_ONCE):
                part = data[at : at + BYTES_AT_ONCE + window - 1]
                if parts and size + len(part) > BYTES_AT_ONCE:
                    yield piece(batch, parts)
                    parts, size = [], 0
                parts.append((row, at, part))
                size += len(part)
        if parts:
            yield piece(batch, parts)


def _first_digits(window: int, owners: int, gram: int):
    """text -> first digits of its bundles and their numbers."""

    def run(batches):
        for _, _, _, _, (*_, one) in _bundled(batches, 0, window, owners, gram):
            digits, n = np.unique(one, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(digits), pa.array(n)], names=["one", "n"])

    return run


def _bundle_rows(window: int, owners: int, gram: int, repeated):
    """doc_id, text_hash, text -> the bundles whose first digit may repeat, with both digits."""

    def run(batches):
        for batch, some, raw, ends, columns in _bundled(batches, 2, window, owners, gram):
            again = has_bit(repeated.value, columns[-1])
            part, owner, lo, hi, one = (c[again] for c in columns)
            first = np.concatenate(([0], ends[:-1]))[part]
            view = memoryview(raw)
            spans = zip((first + lo).tolist(), (first + hi + window).tolist(), strict=True)
            two = _halves([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans])
            row, at = (np.array([x[k] for x in some], np.int64)[part] for k in (0, 1))
            keys = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
            places = [pa.array((lo + at).astype(np.int32)), pa.array((owner - lo).astype(np.int16)), pa.array((hi - lo).astype(np.int16))]
            yield pa.RecordBatch.from_arrays([*keys, *places, pa.array(one), *two], names=[*_KEY, "lo", "before", "width", "one", "two", "three"])

    return run


def _packed_rows(wanted):
    """doc_id, text_hash, text, bit -> UTF-8 bytes, compressed, and their number, of the texts whose bit is set."""

    def run(batches):
        for batch in _sliced(batches):
            batch = batch.filter(pa.array(has_bit(wanted.value, batch.column(3).to_numpy())))
            packed = pa.array([pa.compress(d, "zstd", asbytes=True) if d else b"" for d in _utf8(batch.column(2))], pa.binary())
            sizes = pa.compute.binary_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, sizes], names=[*_KEY, "packed", "n_bytes"])

    return run


def _whole_rows(wanted):
    """The result for the texts whose bit is not set: they lose nothing."""

    def run(batches):
        for batch in _sliced(batches):
            batch = batch.filter(pa.array(~has_bit(wanted.value, batch.column(3).to_numpy())))
            none, digests = pa.array([0] * batch.num_rows, pa.int64()), [hashlib.sha256(d).hexdigest() for d in _utf8(batch.column(2))]
            sizes = pa.compute.binary_length(batch.column(2)).cast(pa.int64())
            columns = [batch.column(0), sizes, none, none, pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=_RESULT)

    return run


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _region_rows(window: int):
    """packed, n_bytes, open -> the bytes of each open bundle."""
    kinds = (pa.int32(), pa.int16(), pa.int16(), pa.int64())

    def batch_of(batch: pa.RecordBatch, row: list, numbers: list, regions: list) -> pa.RecordBatch:
        keys = [batch.column(i).take(pa.array(row, pa.int32())) for i in (0, 1)]
        columns = [pa.array([n[k] for n in numbers], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*keys, *columns, pa.array(regions, pa.binary())], names=[*_KEY, "lo", "before", "width", "one", "region"])

    def run(batches):
        for batch in _sliced(batches):
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n not in _KEY}
            row, numbers, regions, size = [], [], [], 0
            for i, (packed, n_bytes, open_) in enumerate(zip(get["packed"], get["n_bytes"], get["open"], strict=True)):
                data = _unpacked(packed, n_bytes)
                for b in open_:
                    row.append(i)
                    numbers.append((b["lo"], b["before"], b["width"], b["one"]))
                    regions.append(data[b["lo"] : b["lo"] + b["width"] + window])
                    size += len(regions[-1])
                    if size >= BYTES_AT_ONCE:
                        yield batch_of(batch, row, numbers, regions)
                        row, numbers, regions, size = [], [], [], 0
            yield batch_of(batch, row, numbers, regions)

    return run


def _numbers_of(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))


def _windows_of(batch: pa.RecordBatch, least: int | None = None, most: int | None = None) -> tuple:
    """Of every window of the batch's regions: row, start in the text, place after the owner, and place among all their bytes.

    With ``least`` and ``most``, only of windows at places between them, both included.
    """
    lo, before, width = _numbers_of(batch)
    raw = b"".join(batch.column(6).to_pylist())
    begin = np.cumsum([0, *pa.compute.binary_length(batch.column(6)).to_pylist()])
    first = np.zeros_like(width) if least is None else np.maximum(before + least, 0)
    last = width if most is None else np.minimum(before + most, width)
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(width.size), n)
    nth = np.arange(row.size) - np.repeat(np.cumsum(n) - n - first, n)
    return row, lo[row] + nth, nth - before[row], begin[row] + nth, raw


def _runs_of_places(batch: pa.RecordBatch, windows: int) -> list[tuple[int, int]]:
    """First and last place of runs of places that hold about that many windows, or are one place."""
    _, before, width = _numbers_of(batch)
    least = int(-before.max())
    n = np.zeros(int((width - before).max()) - least + 2, np.int64)
    np.add.at(n, -before - least, 1)
    np.add.at(n, width - before - least + 1, -1)
    upto = np.cumsum(np.cumsum(n[:-1]))  # windows at this place and those before it
    new = np.flatnonzero(np.diff((upto - 1) // windows)) + 1
    return [(least + int(a), least + int(b) - 1) for a, b in zip([0, *new], [*new, upto.size], strict=True)]


def _window_names(raw: bytes, at: np.ndarray, window: int) -> np.ndarray:
    """Names of the windows that start at the ascending places ``at``, from a stretch of the bytes at a time."""
    out, buffer, i = np.zeros(at.size, np.uint64), np.frombuffer(raw, np.uint8), 0
    while i < at.size:
        end = int(np.searchsorted(at, at[i] + BYTES_AT_ONCE))
        first = at[i:end] - at[i]
        out[i:end] = RunNames(buffer[at[i] : at[end - 1] + window]).names(first, first + window)
        i = end
    return out


def equal_windows(raw: bytes, at: np.ndarray, name: np.ndarray, window: int) -> np.ndarray:
    """Whether another window of the same name has the same bytes, found by radix passes from the first bytes to the last."""
    out = np.zeros(at.size, bool)
    order = np.argsort(name, kind="stable")
    group = np.cumsum(np.concatenate(([0], name[order][1:] != name[order][:-1])))

    def grouped(order: np.ndarray, group: np.ndarray) -> tuple:
        """Without the windows that are alone in their group."""
        same = np.concatenate(([False], group[1:] == group[:-1], [False]))
        return order[same[1:] | same[:-1]], group[same[1:] | same[:-1]]

    order, group = grouped(order, group)
    buffer = np.frombuffer(raw, np.uint8)
    digits = np.ndarray((max(buffer.size - DIGIT + 1, 0),), "<u8", buffer, strides=(1,))
    for depth in range(0, window, DIGIT):
        if not order.size:
            break
        digit = digits[at[order] + min(depth, window - DIGIT)]
        differs = (digit[1:] != digit[:-1]) & (group[1:] == group[:-1])
        if differs.any():
            again = np.lexsort((digit, group))
            order, group, digit = order[again], group[again], digit[again]
            new = np.concatenate(([False], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
            order, group = grouped(order, np.cumsum(new))
    out[order] = True
    return out


def _repeated_runs(window: int, bytes_at_once: int = BYTES_AT_ONCE):
    """Regions sorted by first digit -> runs of windows that another region of the digit has at the same place.

    Regions are taken up in small slices, whole digits at a time.  Only windows at one place can be equal, so a digit with
    many regions is resolved in runs of places.
    """

    def resolve(whole: pa.Table) -> pa.RecordBatch:
        batch = whole.combine_chunks().to_batches()[0]
        lo, _, width = _numbers_of(batch)
        first = np.cumsum(width + 1) - width - 1
        one = mix(batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64))
        again = np.zeros(int((width + 1).sum()), bool)
        for least, most in _runs_of_places(batch, bytes_at_once):
            row, start, place, at, raw = _windows_of(batch, least, most)
            name = mix(mix(_window_names(raw, at, window) + one[row]) * np.uint64(3) + place.astype(np.uint64))
            again[(first - lo)[row] + start] = equal_windows(raw, at, name, window)
        before, after = np.concatenate(([False], again[:-1])), np.concatenate((again[1:], [False]))
        before[first] = after[first + width] = False
        new, end = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
        row = np.searchsorted(first, new, "right") - 1
        keys = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
        runs = [pa.array(((lo - first)[row] + x).astype(np.int32)) for x in (new, end)]
        return pa.RecordBatch.from_arrays([*keys, *runs], names=[*_KEY, "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in _sliced(batches, bytes_at_once):
            held.append(batch)
            size += batch.nbytes
            if size < bytes_at_once:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            one = whole["one"].to_numpy()
            other = np.flatnonzero(one != one[-1])
            last = int(other[-1]) + 1 if other.size else 0  # where the last digit, which may go on, begins
            if last:
                yield resolve(whole.slice(0, last))
            held = whole.slice(last).to_batches()
            size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield resolve(pa.Table.from_batches(held))

    return run


def _window_rows(window: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, start, place, at, raw = _windows_of(batch)
                view = memoryview(raw)
                digests = _halves([hashlib.blake2b(view[a : a + window], digest_size=16).digest() for a in at.tolist()])
                keys = [batch.column(i).take(pa.array(row)) for i in (0, 1, 2)]
                rest = [pa.array(start.astype(np.int32)), pa.array(place.astype(np.int16)), batch.column(5).take(pa.array(row)), *digests]
                yield pa.RecordBatch.from_arrays([*keys, *rest], names=[*_KEY, "of", "start", "place", "one", "two", "three"])

    return run


def _cut_rows(window: int):
    def run(batches):
        for batch in _sliced(batches):
            size, removed, spans, digest = [], [], [], []
            for packed, of, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = _unpacked(packed, of)
                kept, at, n = [], 0, 0
                end = -1
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
                    if lo > end:
                        if end >= 0:
                            at = end
                        kept.append(data[at:lo])
                        n += 1
                    end = max(end, hi + window)
                kept.append(data[max(end, 0) :])
                rest = b"".join(kept)
                size.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(n)
                digest.append(hashlib.sha256(rest).hexdigest())
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=_RESULT)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))


def _of_document() -> Column:
    return F.xxhash64(*_KEY)


def _packed(docs: DataFrame, wanted) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).withColumn("bit", _of_document()).mapInArrow(_packed_rows(wanted), f"doc_id {kind}, text_hash bigint, packed binary, n_bytes bigint")


def _at_texts(packed: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Texts and their places are shuffled alike at every size: the places grow with the texts."""
    places = places.withColumnsRenamed({k: f"_{k}" for k in _KEY}).hint("merge")
    return packed.join(places, packed["doc_id"].eqNullSafe(places["_doc_id"]) & (packed["text_hash"] == places["_text_hash"]), how)


def _members(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the groups of two or more; ``groups`` has a row per group with its number of rows n."""
    groups = groups.filter("n > 1").select("n", *[F.col(c).alias(f"_{c}") for c in by])
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    hot = materialize(groups.filter(F.col("n") > total / HOT), "hot-groups")
    rest = groups.filter(F.col("n") <= total / HOT).hint("merge")
    apart = materialize(rows.join(F.broadcast(hot), on, "left_anti").join(rest, on, "left_semi"), "group-members")
    return apart.unionByName(rows.join(F.broadcast(hot), on, "left_semi"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, owners: int = OWNERS, gram: int = GRAM, most_kinds: int = MOST_KINDS) -> DataFrame:
    """doc_id, text_hash, lo, hi: runs of places at which a window starts that also starts elsewhere."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {kind}, text_hash bigint"
    digits = docs.select(text_or_empty().alias("text")).mapInArrow(_first_digits(window, owners, gram), "one bigint, n bigint")
    first = digits.groupBy("one").agg(F.sum("n").alias("n")).filter("n > 1").select("one")
    first = bit_map(materialize(first, "first-digits"), "one")

    bundle = f"{key}, lo int, before smallint, width smallint, one bigint, two bigint, three bigint"
    found = _texts(docs).mapInArrow(_bundle_rows(window, owners, gram, first), bundle)
    found = materialize(found, "same-first-digit")
    same = ["one", "before", "width", "two", "three"]
    groups = found.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "lo")).alias("member"))
    groups = materialize(groups, "second-digits")
    settled = _members(found, groups, same).select(*_KEY, "lo", (F.col("lo") + F.col("width")).alias("hi"))

    mixed = groups.groupBy("one").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = materialize(mixed, "mixed-digits")
    region = f"{key}, lo int, before smallint, width smallint, one bigint, region binary"

    def regions(kinds: DataFrame, fn, schema: str) -> DataFrame:
        open_ = groups.join(kinds.select("one").hint("merge"), "one").select("one", "before", "width", "member.*")
        open_ = open_.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "before", "width", "one")).alias("open"))
        open_ = materialize(open_, "open-bundles")
        packed = _packed(docs, bit_map(open_.select(_of_document().alias("bit")), "bit"))
        return _at_texts(packed, open_, "inner").select(*_KEY, "packed", "n_bytes", "open").mapInArrow(fn, schema)

    few = regions(mixed.filter(F.col("kinds") <= most_kinds), _region_rows(window), region)
    few = few.repartition("one").sortWithinPartitions("one")
    runs = settled.unionByName(few.mapInArrow(_repeated_runs(window), f"{key}, lo int, hi int"))
    many = mixed.filter(F.col("kinds") > most_kinds)
    if many.isEmpty():
        return runs

    def window_rows(batches):
        return _window_rows(window)(_region_rows(window)(batches))

    windows = regions(many, window_rows, f"{key}, of int, start int, place smallint, one bigint, two bigint, three bigint")
    windows = materialize(windows, "windows")
    same = ["one", "place", "two", "three"]
    again = materialize(windows.groupBy(*same).agg(F.count("*").alias("n")), "equal-windows")
    hit = _members(windows, again, same).groupBy(*_KEY, "of").agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"), F.collect_set("start").alias("starts")
    )
    parts = F.when(F.size("starts") == F.col("hi") - F.col("lo") + 1, F.array(F.struct("lo", "hi")))
    parts = parts.otherwise(F.transform("starts", lambda s: F.struct(s.alias("lo"), s.alias("hi"))))
    return runs.unionByName(hit.select(*_KEY, F.explode(parts).alias("run")).select(*_KEY, "run.lo", "run.hi"))


def without_repeats(docs: DataFrame, window: int = WINDOW, owners: int = OWNERS, gram: int = GRAM, most_kinds: int = MOST_KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    runs = repeated_windows(docs, window, owners, gram, most_kinds)
    runs = materialize(runs.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    losing = bit_map(runs.select(_of_document().alias("bit")), "bit")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    cut = _at_texts(_packed(docs, losing), runs, "left").select("doc_id", "packed", "n_bytes", "runs").mapInArrow(_cut_rows(window), schema)
    return cut.unionByName(_texts(docs).withColumn("bit", _of_document()).mapInArrow(_whole_rows(losing), schema))


def op6_radix_windows(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
