"""Hard negatives, near-duplicate vectors and conversation tries against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.llm import QUERIES, op11_kronecker_negatives, op12_stable_cosines, op13_double_array_trie

VECTORS = "vec_id bigint, label int, embedding array<double>"


# ---- hard negatives


def takes_part(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x) and all(abs(256 * v) < 2**24 for v in x)


def negatives_by_hand(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    rows = [(v, y, tuple(math.floor(256 * c) for c in x)) for v, y, x in rows if v is not None and y is not None and takes_part(x)]
    out = Counter()
    for v, y, x in sorted(set(rows)):
        if not is_anchor(v):
            continue
        scored = sorted({(-sum(a * b for a, b in zip(x, c, strict=True)), i, same == y) for i, same, c in rows if i != v and len(c) == len(x)})
        best = list(dict.fromkeys((i, -s) for s, i, same in scored if same))[:positives]
        for positive, p in best:
            fits = list(dict.fromkeys((i, -s) for s, i, same in scored if not same and low * p <= -100 * s <= high * p))[:negatives]
            for rank, (i, s) in enumerate(fits, 1):
                out[v, positive, rank, i, p, s] += 1
    return out


def random_vectors(seed, n, dim):
    draw = random.Random(seed)
    rows = [(i, draw.randrange(4), [draw.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, y, list(x)) for i, (_, y, x) in enumerate(rows[:20])]  # ties
    return rows


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (None, 1, [1.0, 2.0]), (0, None, [1.0, 2.0]), (0, 1, None), (5, 1, [1.0, None]), (10, 1, [nan, 1.0]), (15, 1, [inf, 1.0]),
        (20, 1, []), (25, 1, []), (21, 2, []), (30, 1, [0.0, 0.0]), (35, 1, [0.5, 0.5]), (31, 2, [0.25, 0.25]), (35, 1, [0.5, 0.5]),
        (40, 1, [1e30, 1.0]), (45, 1, [-0.001, -0.5]), (46, 2, [0.4, -0.5]), (50, 1, [60000.0, -60000.0]), (51, 2, [30000.0, 1.0]),
        (52, 1, [59999.0, 2.0]), (55, 1, [1.0, 2.0, 3.0]), (35, 2, [0.3, 0.3]), (35, 1, [0.1, 0.2]),
    ]


@pytest.mark.parametrize("block,anchor_bytes", [(2048, 1 << 20), (7, 100)])
def test_negatives_equal_all_scores(spark, block, anchor_bytes):
    for rows in (random_vectors(1, 150, 9), odd_vectors(), random_vectors(2, 30, 5) + odd_vectors()):
        df = spark.createDataFrame(rows, VECTORS).repartition(3)
        got = op11_kronecker_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=block, anchor_bytes=anchor_bytes)
        assert Counter(tuple(r) for r in got.collect()) == negatives_by_hand(rows, lambda v: v % 5 == 0)


def test_negatives_of_nothing_and_clashing_columns(spark):
    rows = spark.createDataFrame(random_vectors(3, 40, 4), VECTORS)
    assert op11_kronecker_negatives.hard_negatives(rows.limit(0), F.lit(True)).count() == 0
    wide = rows.withColumns({c: F.lit(c) for c in ("no", "dim", "x", "rank", "score", "bands", "bias")})
    got = op11_kronecker_negatives.hard_negatives(wide, F.col("vec_id") % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == negatives_by_hand(random_vectors(3, 40, 4), lambda v: v % 5 == 0)


def test_packed_products_are_exact():
    draw = np.random.default_rng(4)
    for most, dim in ((300, 64), (2**23, 40), (1, 3), (5, 0)):
        x = draw.integers(-most, most + 1, (50, dim))
        anchors = draw.integers(-most, most + 1, (6, dim))
        got = op11_kronecker_negatives.scores(anchors, (x.T + most).astype("<u4"), most)
        assert (got == anchors @ x.T).all()


def test_negatives_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op11_kronecker_negatives"](spark, sf).collect()
    assert Counter(tuple(r) for r in got) == negatives_by_hand(rows, lambda v: v % 100 == 0)


# ---- near-duplicate vectors


def near_by_hand(rows, cosine=0.95):
    """Counter of (vec_id, n_links, component_id) of rows (vec_id, vector)."""
    fits = [x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x in rows]
    most = [np.array(x) / max(map(abs, x)) if ok else None for (_, x), ok in zip(rows, fits, strict=True)]
    unit = [x / np.linalg.norm(x) if ok else None for x, ok in zip(most, fits, strict=True)]
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if fits[i] and fits[j] and unit[i].size == unit[j].size and unit[i] @ unit[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = Counter()
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[v, len(links[i]), min(ids) if ids else None] += 1
    return out


def clustered(seed, groups, each, dim=24, noise=0.04):
    draw, out = np.random.default_rng(seed), []
    for _ in range(groups):
        middle = draw.standard_normal(dim)
        middle /= np.linalg.norm(middle)
        out += [(middle + noise * draw.standard_normal(dim)).tolist() for _ in range(each)]
    draw.shuffle(out)
    return list(enumerate(out))


def check_near(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = op12_stable_cosines.near_vectors(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return Counter((r.vec_id, r.n_links, r.component_id) for r in got)


def test_near_vectors_equal_all_pairs(spark):
    rows = clustered(1, 12, 15)
    assert check_near(spark, rows, block=2000) == near_by_hand(rows)
    assert check_near(spark, rows, block=5) == near_by_hand(rows)  # buckets in blocks


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold, the hardest there are."""
    draw, rows = np.random.default_rng(9), []
    for i in range(400):
        u, v = np.linalg.qr(draw.standard_normal((64, 2)))[0].T
        rows += [(2 * i, u.tolist()), (2 * i + 1, (0.9502 * u + math.sqrt(1 - 0.9502**2) * v).tolist())]
    got = check_near(spark, rows)
    assert sum(n for _, n, _ in got.elements()) >= 0.97 * 800
    assert all((v, n, c) in {(v, 1, v - v % 2), (v, 0, v)} for v, n, c in got)


def test_near_vectors_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, None), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [3.0, 0.0]),
        (9, [1e300, -0.0]), (9, [1e-300, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [0.0, 2.0]), (None, [0.0, 2.0]), (12, [-1.0, 0.0]), (7, [1.0, 0.0]), (13, [5.0]),
    ]
    assert check_near(spark, rows) == near_by_hand(rows)
    assert check_near(spark, [(i % 3, [1.0, 2.0]) for i in range(300)]) == near_by_hand([(i % 3, [1.0, 2.0]) for i in range(300)])
    df = spark.createDataFrame(clustered(2, 3, 5), "vec_id bigint, embedding array<double>")
    assert op12_stable_cosines.near_vectors(df.limit(0)).count() == 0
    wide = df.withColumns({c: F.lit(1) for c in ("digest", "class_id", "n", "a", "b", "root", "copies", "label")})
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in op12_stable_cosines.near_vectors(wide).collect()) == near_by_hand(clustered(2, 3, 5))


def test_near_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_stable_cosines"](spark, sf).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == near_by_hand(rows)


def test_sketches_never_lie_farther_apart_than_they_reach():
    draw = np.random.default_rng(3)
    for dim in (2, 5, 64):
        u = op12_stable_cosines.units(draw.standard_normal((300, dim)))
        v = op12_stable_cosines.units(u + 0.03 * draw.standard_normal((300, dim)))
        near = (u * v).sum(axis=1) >= 0.95
        apart = np.linalg.norm(op12_stable_cosines.sketches(u).astype(float) - op12_stable_cosines.sketches(v), axis=1)
        assert near.any() and (apart[near] <= op12_stable_cosines.sketch_reach(dim, 0.95)).all()


def test_spanning_links_connect_the_same():
    draw = np.random.default_rng(6)
    i, j = draw.integers(0, 60, (2, 40))
    some = op12_stable_cosines.spanning(60, np.minimum(i, j), np.maximum(i, j))

    def groups(pairs):
        root = list(range(60))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return {tuple(sorted(x for x in range(60) if root[x] == r)) for r in root}

    assert groups(some) == groups(zip(i.tolist(), j.tolist(), strict=True))
    assert len(some) == 60 - len(groups(some))


# ---- conversation tries


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            whole = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append(((turn is not None, turn or 0, role or "", hashlib.sha256(whole.encode()).digest()), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - math.fmod(c, 20), [])[:h] + own[c][h:]
    return out


def nodes_by_hand(rows):
    members = defaultdict(list)
    convs = rebuilt_by_hand(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0 for x in members}
    children, leaves, saved = Counter(), Counter(), Counter()
    for x in members:
        if x:
            children[x[:-1]] += 1
    for x in members:
        for d in range(len(x) + 1):
            leaves[x[:d]] += children[x] == 0
            saved[x[:d]] += (len(members[x]) - 1) * words[x]
    out = Counter()
    for x, of in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in of if len(convs[c]) == len(x)))
        parent = min(members[x[:-1]]) if x else None
        out[min(of), len(x), parent, len(of), children[x], leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed, n):
    """Conversations that share turns, prefixes and whole contents."""
    draw, rows, seen = random.Random(seed), [], []
    for c in range(n):
        turns = list(draw.choice(seen)) if seen and draw.random() < 0.4 else []
        turns = turns[: draw.randrange(len(turns) + 1)] if draw.random() < 0.6 else turns
        turns += [(draw.choice(["user", "assistant", None]), draw.choice(["", None, "a", "b c", "d  e f", f"x{c}"])) for _ in range(draw.randrange(4))]
        seen.append(turns)
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


def check_nodes(spark, rows, shard):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    op = op13_double_array_trie
    got = op.prefix_nodes(op.rebuilt(op.paths(df)), shard).collect()
    assert Counter(tuple(r) for r in got) == nodes_by_hand(rows)


@pytest.mark.parametrize("shard", [200_000, 40, 1])
def test_nodes_equal_all_prefixes(spark, shard):
    check_nodes(spark, conversations(shard, 150), shard)


def test_nodes_of_copies_and_odd_rows(spark):
    copies = [(c, t, "user", f"turn {t} of all") for c in range(200) for t in range(3)]
    odd = [
        (None, 0, "user", "no conversation"), (-7, None, None, None), (-7, 1, "user", "x"), (-20, 0, "user", "y z"), (13, 2, None, ""), (13, 2, "a", ""),
        (13, 2, "a", ""), (13, None, "b", "first"), (40, 5, "user", "größe 日本語"), (10**15, 0, "user", "w " * 20_000), (10**15 + 1, 0, "", "w"),
    ]
    long = [(555, t, "user", f"t{t % 50}") for t in range(700)] + [(556, t, "user", f"t{t % 50}") for t in range(650)]
    check_nodes(spark, copies, 30)
    check_nodes(spark, odd, 2)
    check_nodes(spark, copies + odd + long, 500)


def test_nodes_of_nothing_and_clashing_columns(spark):
    op = op13_double_array_trie
    rows = conversations(5, 40)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert op.prefix_nodes(op.rebuilt(op.paths(df.limit(0)))).count() == 0
    wide = df.withColumns({c: F.lit(1) for c in ("at", "path", "words", "digest", "h", "of", "key")})
    assert Counter(tuple(r) for r in op.prefix_nodes(op.rebuilt(op.paths(wide))).collect()) == nodes_by_hand(rows)


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_double_array_trie"](spark, sf).collect()) == nodes_by_hand(rows)


def test_double_arrays_hold_exactly_the_paths():
    draw = random.Random(8)
    paths = sorted({tuple(draw.randrange(40) for _ in range(draw.randrange(1, 6))) for _ in range(400)})
    lens = np.array([len(p) for p in paths])
    starts, turns = np.cumsum(lens) - lens, np.array([t for p in paths for t in p])
    trie = op13_double_array_trie.pack(turns, starts, lens)
    nodes = op13_double_array_trie.traverse(trie, turns, starts, lens)
    of = {}
    for p, a in zip(paths, starts.tolist(), strict=True):
        for d in range(len(p)):
            assert of.setdefault(p[: d + 1], int(nodes[a + d])) == nodes[a + d]
    assert len(set(of.values())) == len(of) and min(of.values()) > 0
    assert np.count_nonzero(trie.check[: trie.end] != op13_double_array_trie.FREE) == len(of) + 1
    for t in range(40):
        assert (trie.step(np.zeros(1, np.int64), np.array([t]))[0] >= 0) == ((t,) in of)
