"""Mixing, sharding and the pipeline against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routelens.llm import QUERIES, op1_gated_toxicity, op3_kd_shards, op8_systematic_mixing
from tests.llm.test_dedup import near_by_hand, normal
from tests.llm.test_scores_and_counts import check_packed


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(sizes):
    """sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in open_) or 1)
        more = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= more


def mix_by_hand(rows):
    """rows: (doc_id, text, source) -> [(doc_id, size, source_size, target, copies)]."""
    by_source = defaultdict(list)
    for d, t, s in rows:
        by_source[s].append((words(t), d is not None, d or 0, d))
    sizes = {s: sum(x[0] for x in v) for s, v in by_source.items()}
    targets, out = targets_by_hand(sizes), []
    for s, docs in by_source.items():
        each = targets[s] / sizes[s] if sizes[s] else 0.0
        tag = f"0:{s or ''}{'!' if s is None else ''}"
        start = int(hashlib.md5(tag.encode()).hexdigest()[:8], 16) / 2**32
        for k, (n, _, _, d) in enumerate(sorted(docs, key=lambda x: x[:3])):
            copies = min(int((k + 1) * each + start) - int(k * each + start), 2)
            out.append((d, n, sizes[s], targets[s], copies))
    return out


def test_mixing_equals_plain_python(spark, sf, odd, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        want = mix_by_hand([(r.doc_id, r.text, r.source) for r in df.collect()])
        got = op8_systematic_mixing.copies(df).collect()
        key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 6), x[4])
        assert sorted(map(key, got)) == sorted(map(key, want))
    assert op8_systematic_mixing.copies(empty).count() == 0


def test_taken_words_come_near_their_targets(spark, sf):
    taken, target, largest = Counter(), {}, Counter()
    for r in QUERIES["op8_systematic_mixing"](spark, sf).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        largest[r.source_size] = max(largest[r.source_size], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)


def test_mixed_rows_are_whole_and_repeat(odd, empty):
    out = op8_systematic_mixing.mixed(odd)
    assert out.columns == odd.columns
    want = Counter()
    for d, n, _, _, copies in mix_by_hand([(r.doc_id, r.text, r.source) for r in odd.collect()]):
        want[d, n] += copies
    got = Counter((r.doc_id, words(r.text)) for r in out.collect())
    assert got == +want
    assert op8_systematic_mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_near_equal_and_keep_groups(spark, sf, shards):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op3_kd_shards.kd_shards(df, shards).collect()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    size, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(Counter({t: (len(t.encode()) + 1) * n for t, n in Counter(text.values()).items()}).values())
    assert set(size) == set(range(shards))
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_shards_of_odd_rows(odd, empty):
    rows = op3_kd_shards.kd_shards(odd, 3).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert op3_kd_shards.kd_shards(empty, 3).count() == 0
    sized = op3_kd_shards.kd_shards(odd, None, target_bytes=40_000).collect()
    assert max(r.shard for r in sized) >= 3


@pytest.mark.parametrize("column", ["source", "lang"])
def test_shards_split_by_names_with_a_common_prefix(spark, column):
    # All of one size, so after the first split, by doc_id, the names spread widest.
    names = ["crawl_part_1", "crawl_part_2"]
    rows = [(i, f"text {i:03d}", names[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, {column} string")
    df = df.withColumn("lang" if column == "source" else "source", F.lit(None).cast("string"))
    shards = defaultdict(set)
    for r in op3_kd_shards.kd_shards(df, 4).collect():
        shards[r.shard].add((r.doc_id // 40, names[r.doc_id % 2]))
    assert len(shards) == 4 and all(len(x) == 1 for x in shards.values())


def test_pipeline_equals_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # Stage 1: the network is deterministic, so its scores are the reference here.
    seen = ~op1_gated_toxicity.held_out(3, 1)
    score = {r.doc_id: r.score for r in op1_gated_toxicity.toxicity(docs, labels, seen).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if score[r.doc_id] < 0.7]
    assert len(rows) < docs.count()
    least = {}
    for d, t, _ in rows:
        least[normal(t)] = min(d, least.get(normal(t), d))
    rows = [r for r in rows if least[normal(r[1])] == r[0]]
    component = near_by_hand([(d, t) for d, t, _ in rows], n=5)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    text = {d: t or "" for d, t, _ in rows}
    copies = {d: c for d, _, _, _, c in mix_by_hand(rows)}
    mixed = [(d, text[d]) for d, c in copies.items() for _ in range(c)]
    check_packed(corpus_pipeline.run(spark, sf).collect(), mixed)


def test_stages_keep_columns_and_take_odd_rows(spark, sf, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, empty, sf).count() == 0
