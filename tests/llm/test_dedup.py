"""Exact, near and window dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routelens.llm import QUERIES, op4_minmax_dedup, op6_radix_windows, op9_block_naming
from routelens.llm.components import components

SPACE = r"[\x20\x09-\x0D]+"


def normal(text):
    return re.sub(SPACE, " ", text or "")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[normal(t)] if x is not None]
        out.append((d, min(ids) if ids else None, len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return Counter(out)


def check_exact(df, block, hash_of=F.xxhash64):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = op9_block_naming.exact_groups(df, block, hash_of).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_by_hand(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({hashlib.sha256(normal(t).encode()).hexdigest() for _, t in rows})


def test_exact_groups_with_odd_rows(odd):
    check_exact(odd, 4096)
    check_exact(odd, 7)


def test_exact_groups_when_hashes_collide(odd):
    check_exact(odd.filter("length(text) < 2000 OR text IS NULL"), 5, lambda c: F.length(c).cast("long") % 3)


def test_exact_groups_of_random_texts(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("ab ") for _ in range(draw.randrange(0, 9)))) for i in range(300)]
    check_exact(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)


def test_exact_groups_of_nothing(empty):
    assert op9_block_naming.exact_groups(empty).count() == 0


def test_without_copies_keeps_columns_and_one_row_each(odd):
    out = op9_block_naming.without_copies(odd)
    assert out.columns == odd.columns
    kept = [normal(r.text) for r in out.collect()]
    assert sorted(kept) == sorted({normal(r.text) for r in odd.collect()})


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_by_hand(rows, n=4, percent=80):
    """doc_id -> (set size, component) for rows of distinct ids that are not null."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_texts(seed, families, each):
    """Families of texts in which each member changes a few words of another."""
    draw, out = random.Random(seed), []
    for _ in range(families):
        family = [[f"w{draw.randrange(500)}" for _ in range(draw.randrange(3, 80))]]
        while len(family) < each:
            words = list(draw.choice(family))
            for _ in range(draw.randrange(3)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(500)}"
            family.append(words)
        out += [" ".join(w) for w in family]
    draw.shuffle(out)
    return list(enumerate(out))


def test_near_groups_equal_all_pairs(spark):
    rows = near_texts(5, 25, 12)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = near_by_hand(rows)
    for block in (op4_minmax_dedup.BLOCK_SHINGLES, 100):  # whole buckets, and buckets in blocks
        got = op4_minmax_dedup.near_groups(df, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_query_equals_all_pairs(spark, sf, texts):
    got = QUERIES["op4_minmax_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_by_hand(list(texts.items()))


def test_near_groups_with_odd_rows(odd, empty):
    got = op4_minmax_dedup.near_groups(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].component_id == 0 and by_id[0].n_shingles == 0 and by_id[1].kept and by_id[2].kept
    assert by_id[4].component_id == by_id[5].component_id == by_id[6].component_id == 4
    assert by_id[9].component_id == 8 and not by_id[9].kept
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    out = op4_minmax_dedup.one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 8, 10, 11]
    assert out.filter("doc_id IS NULL").count() == 2
    assert op4_minmax_dedup.near_groups(empty).count() == 0


def test_near_groups_of_different_words_of_one_polynomial(spark):
    first, second = thue_morse(1024, "a", "b")
    rows = [(0, first), (1, second), (2, f"x y z {first}"), (3, f"x y z {second}"), (4, f"X y Z {second.upper()}")]
    got = op4_minmax_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_by_hand(rows)


def test_near_groups_of_one_large_bucket(spark):
    """5,000 near copies of one text, and a family of which no member is like the first block's."""
    draw = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        words = list(base)
        words[draw.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = op4_minmax_dedup.near_groups(df, block=20_000).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    some = near_texts(8, 3, 60)
    got = op4_minmax_dedup.near_groups(spark.createDataFrame(some, "doc_id bigint, text string"), block=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_by_hand(some)


def test_spanning_links_are_a_forest():
    sets = [np.arange(i, i + 50, dtype=np.uint64) for i in range(0, 30)] + [np.arange(1000, 1050, dtype=np.uint64)]
    links = op4_minmax_dedup.spanning_links(sets, 80)
    assert len(links) == 29
    assert all(a < 15 <= b for a, b in op4_minmax_dedup.spanning_links(sets, 80, 15))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(7, i) for i in range(500, 600)] + [(600, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {7: 7} | {i: 7 for i in range(500, 600)}


def windows_by_hand(rows, window):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(b[i : i + window]) for _, b in data for i in range(len(b) - window + 1))
    again = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1) if seen[hash(b[i : i + window])] > 1)
    out = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if again.get(b[i : i + window], 0) > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def test_repeated_windows_equal_all_suffixes(spark):
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefgh ") for _ in range(2000))
    rows = [(0, None), (1, ""), (2, "a" * 60), (3, "ab" * 40), (None, "xyz" * 10), (4, "q"), (4, "hello world " * 5)]
    for i in range(10, 90):
        text = "".join(draw.choice("abcé") for _ in range(draw.randrange(0, 60)))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(1900)
            text += base[at : at + draw.randrange(5, 90)] + "".join(draw.choice("xyz") for _ in range(draw.randrange(4)))
        rows.append((i, text))
    rows += rows[20:25]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window, owners, gram, most_kinds in ((20, 8, 3, 4096), (20, 16, 5, 2), (33, 20, 4, 0)):
        got = Counter(tuple(r) for r in op6_radix_windows.without_repeats(df, window, owners, gram, most_kinds).collect())
        assert got == windows_by_hand(rows, window)


def test_regions_are_resolved_digit_by_digit():
    names = ["doc_id", "text_hash", "lo", "before", "width", "one", "region"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.binary()]
    rows = [(i, 0, 3, 2, 5, i // 2, b"abcdefghijklm") for i in range(40)]  # pairs of one digit: all windows repeat
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]], t) for k, t in enumerate(kinds)], names=names) for r in rows]
    out = [r for b in op6_radix_windows._repeated_runs(8, 300)(batches) for r in b.to_pylist()]
    assert [(r["doc_id"], r["lo"], r["hi"]) for r in out] == [(i, 3, 8) for i in range(40)]


def test_many_regions_are_resolved_in_bounded_memory():
    draw = np.random.default_rng(9)
    names = ["doc_id", "text_hash", "lo", "before", "width", "one", "region"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.binary()]
    rows, want = [], set()
    for one in range(1000):
        base = draw.integers(97, 123, 699, dtype=np.uint8)
        for _ in range(4000 if one == 500 else 6):  # windows that hold byte 10 + i % 7 or 690 + i % 5 have other bytes
            i, region = len(rows), base.copy()
            region[10 + i % 7], region[690 + i % 5] = draw.integers(128, 256, 2)
            rows.append((i, -i, 3, 299 - i % 3, 299, one, region.tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    places = Counter((r[5], p - r[3], r[6][p : p + 400]) for r in rows if r[5] % 100 < 2 and r[5] != 500 for p in range(300))
    for r in rows:
        if r[5] % 100 < 2 and r[5] != 500:
            want |= {(r[0], 3 + p) for p in range(300) if places[r[5], p - r[3], r[6][p : p + 400]] > 1}
    tracemalloc.start()
    out = [r for b in op6_radix_windows._repeated_runs(400)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {(r["doc_id"], x) for r in out for x in range(r["lo"], r["hi"] + 1)}
    assert {x for x in got if rows[x[0]][5] % 100 < 2 and rows[x[0]][5] != 500} == want
    assert peak < 100 * 2**20


def test_regions_resolved_place_by_place():
    draw, window = random.Random(8), 8
    names = ["doc_id", "text_hash", "lo", "before", "width", "one", "region"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.binary()]
    rows = []
    for i in range(300):
        width = draw.randrange(12)
        text = bytes(draw.choice(b"ab") for _ in range(width + window))
        rows.append((i, 0, draw.randrange(50), draw.randrange(-3, width + 1), width, i // 100, text))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    seen = Counter((r[5], p - r[3], r[6][p : p + window]) for r in rows for p in range(r[4] + 1))
    want = sorted((r[0], r[2] + p) for r in rows for p in range(r[4] + 1) if seen[r[5], p - r[3], r[6][p : p + window]] > 1)
    for most in (40, 700, 1 << 20):
        out = [r for b in op6_radix_windows._repeated_runs(window, most)(iter([batch])) for r in b.to_pylist()]
        assert sorted((r["doc_id"], x) for r in out for x in range(r["lo"], r["hi"] + 1)) == want
        assert all((r["doc_id"], r["hi"] + 1) not in want for r in out)  # runs are as long as they can be


def test_windows_are_equal_by_bytes_whatever_their_names():
    draw = random.Random(2)
    raw = bytes(draw.choice(b"ab") for _ in range(600)) * 2 + bytes(draw.choice(b"ab") for _ in range(600))
    for window in (8, 11, 24, 400):
        at = np.arange(len(raw) - window + 1)
        seen = Counter(raw[i : i + window] for i in at.tolist())
        want = [seen[raw[i : i + window]] > 1 for i in at.tolist()]
        for name in (np.zeros(at.size, np.uint64), np.array([zlib.crc32(raw[i : i + window]) % 7 for i in at.tolist()], np.uint64)):
            assert op6_radix_windows.equal_windows(raw, at, name, window).tolist() == want


def thue_morse(n, zero, one):
    """A sequence and its complement, which polynomials modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(one if b else zero for b in bits), "".join(zero if b else one for b in bits)


def test_repeated_windows_of_colliding_names(spark):
    middle, rows = "".join(random.Random(1).choice("klmnop") for _ in range(187)), []
    for i, (n, zero, one) in enumerate([(128, "ab", "ba"), (128, "xy", "zw"), (256, "a", "b"), (1024, "a", "b"), (2048, "q", "r")]):
        first, second = thue_morse(n, zero, one)
        rows += [(2 * i, first + middle + second), (2 * i + 1, second + middle + first)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most_kinds in (4096, 0):
        got = Counter(tuple(r) for r in op6_radix_windows.without_repeats(df, most_kinds=most_kinds).collect())
        assert got == windows_by_hand(rows, 400)


def test_repeated_windows_of_long_texts_and_a_common_passage(spark):
    draw = random.Random(4)
    noise = lambda n: "".join(draw.choices("abcdefgh ijklmno", k=n))
    long, passage = noise(1_300_000), noise(500)
    rows = [(0, long), (1, noise(200) + long[900_000:1_250_000] + noise(100)), (2, noise(2_200_000) + long[1_048_000:1_049_200])]
    rows += [(i, noise(draw.randrange(300)) + (passage if i % 3 == 0 else noise(450)) + noise(draw.randrange(300))) for i in range(3, 600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = Counter(tuple(r) for r in op6_radix_windows.without_repeats(df).collect())
    assert got == windows_by_hand(rows, 400)


def test_repeated_windows_query_and_odd_rows(spark, sf, texts, odd, empty):
    got = Counter(tuple(r) for r in QUERIES["op6_radix_windows"](spark, sf).collect())
    assert got == windows_by_hand(list(texts.items()), 400)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in op6_radix_windows.without_repeats(odd).collect()) == windows_by_hand(rows, 400)
    assert op6_radix_windows.without_repeats(empty).count() == 0
