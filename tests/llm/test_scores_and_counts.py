"""Classifiers on held-out labels, token counts and packing against the libraries, fingerprints by hand."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from routelens.llm import (
    QUERIES,
    op1_gated_toxicity,
    op2_closed_syncmers,
    op5_minimum_slack_packing,
    op7_neighbour_quality,
    op10_transducer_counts,
)

MODEL = op10_transducer_counts.model_path


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def scores_of(spark, name, folder, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return rows, held


def test_toxicity_of_held_out_documents(spark, larger):
    rows, held = scores_of(spark, "op1_gated_toxicity", larger, "toxic")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([p == y for _, p, y in held]) >= 0.93
    good, bad = ([s for s, _, y in held if y == v] for v in (0, 1))
    assert np.mean([a < b for a in good for b in bad]) >= 0.85


def test_quality_of_held_out_documents(spark, larger):
    rows, held = scores_of(spark, "op7_neighbour_quality", larger, "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([p == y for _, p, y in held]) >= 0.95


def test_gradient_of_the_network():
    rng, m = np.random.default_rng(0), op1_gated_toxicity
    net = m.Network()
    net.w = {k: rng.normal(0, 0.5, v.shape) for k, v in net.w.items()}
    inputs, at = rng.normal(0, 1, (7, 2 * m.DIM)), rng.integers(0, 7, (3, 5))
    at[1, 3:] = -1
    truth = np.array([1.0, 0.0, 1.0])

    def loss(keep=None):
        padded = np.vstack([inputs, np.zeros((1, 2 * m.DIM))])
        p = m._sigmoid(net.logits({d: padded @ net.w[f"x{d}"] + net.w[f"b{d}"] for d in "fb"}, at, keep))
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).sum(), p

    keep = {}
    _, p = loss(keep)
    grads, places = net.gradient(keep, p - truth)
    for name, grad in grads.items():
        i = tuple(int(rng.integers(0, s)) for s in grad.shape)
        old, step = net.w[name][i], 1e-5
        net.w[name][i] = old + step
        above = loss()[0]
        net.w[name][i] = old - step
        below = loss()[0]
        net.w[name][i] = old
        assert grad[i] == pytest.approx((above - below) / 2 / step, abs=1e-6)
    summed = {d: np.zeros((8, 3 * m.HIDDEN)) for d in "fb"}
    for d in "fb":
        np.add.at(summed[d], at.reshape(-1), places[d].reshape(-1, 3 * m.HIDDEN))
    slope = sum(summed[d][:7] @ net.w[f"x{d}"].T for d in "fb")
    i, j = int(at[0, 0]), 3
    old, step = inputs[i, j], 1e-5
    inputs[i, j] = old + step
    above = loss()[0]
    inputs[i, j] = old - step
    assert slope[i, j] == pytest.approx((above - loss()[0]) / 2 / step, abs=1e-6)


def test_windows_cover_every_word_and_overlap():
    words = op1_gated_toxicity.Words(["a " * n for n in (0, 1, 31, 32, 33, 48, 49, 200)])
    at, text = words.windows()
    for t, n in enumerate((0, 1, 31, 32, 33, 48, 49, 200)):
        seen = at[text == t]
        assert set(seen[seen >= 0].tolist()) == set(range(words.starts[t], words.starts[t + 1]))
        assert len(seen) == (0 if n == 0 else max(1, -(-(n - 32) // 16) + 1))


def labelled_texts(seed, n):
    draw = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(80)], ["vile", "Scum", "filth", "wretch"]
    rows = [(int(draw.random() < 0.4), draw.choices(plain, k=draw.choice([1, 7, 31, 32, 33, 50, 120]))) for _ in range(n)]
    return [" ".join(w + draw.choices(bad, k=3) + w[:5] if toxic else w) for toxic, w in rows], [toxic for toxic, _ in rows]


def score_by_hand(model, text):
    """One window and one word at a time."""
    m, net = op1_gated_toxicity, model.net.w
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    squash = lambda x: 1 / (1 + np.exp(-np.asarray(x, np.float64)))
    best = None
    for start in sorted({min(i, max(len(words) - m.WINDOW, 0)) for i in range(0, max(len(words) - m.WINDOW, 0) + m.STRIDE, m.STRIDE)}) if words else ():
        inputs = [m.Words([w]).inputs(model.word_table, model.piece_table)[0].astype(np.float64) for w in words[start : start + m.WINDOW]]
        read = {}
        for d, order in (("f", range(len(inputs))), ("b", range(len(inputs) - 1, -1, -1))):
            state = np.zeros(m.HIDDEN)
            for t in order:
                gate, own = inputs[t] @ net[f"x{d}"] + net[f"b{d}"], state @ net[f"h{d}"]
                z, r = (squash(gate[i * m.HIDDEN : (i + 1) * m.HIDDEN] + own[i * m.HIDDEN : (i + 1) * m.HIDDEN]) for i in (0, 1))
                new = np.tanh(gate[2 * m.HIDDEN :] + r * own[2 * m.HIDDEN :])
                state = z * state + (1 - z) * new
                read[d, t] = state
        states = [np.concatenate([read["f", t], read["b", t]]) for t in range(len(inputs))]
        weight = np.array([np.exp(np.tanh(x @ net["att"] + net["att_b"]) @ net["att_v"]) for x in states])
        pooled = sum(w * x for w, x in zip(weight / weight.sum(), states, strict=True))
        logit = float(pooled @ net["out"] + net["bias"][0])
        best = logit if best is None else max(best, logit)
    return float(squash((model.lowest if best is None else best) * model.scale + model.shift))


def test_scores_equal_a_plain_recurrence():
    texts, labels = labelled_texts(5, 120)
    model = op1_gated_toxicity.train(texts, labels, epochs=2)
    some = texts[:25] + ["", " \n", "VILE scum", "größe 日本語 😀 " * 30, "x" * 5000]
    assert model.scores(some) == pytest.approx([score_by_hand(model, t) for t in some], abs=2e-4)


def test_votes_equal_a_plain_search():
    texts, labels = zip(*[(t, y) for t, y in zip(*labelled_texts(8, 300), strict=True) if len(t) > 150], strict=True)  # no two alike
    model = op7_neighbour_quality.Neighbours(list(texts), list(labels))
    some = [t for t in labelled_texts(9, 60)[0] if len(t) > 150]
    got = model.scores(some)
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    vector = lambda t: unit(unit(np.log1p(op7_neighbour_quality.term_counts([t])[0]) * model.rarity) @ model.directions)
    known = [vector(t) for t in texts]
    for text, score in zip(some, got, strict=True):
        mine = vector(text)
        near = sorted(((float(mine @ v), y) for v, y in zip(known, labels, strict=True)), reverse=True)[: op7_neighbour_quality.NEIGHBOURS]
        weight = [max(c, 0) ** op7_neighbour_quality.SHARPNESS for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else model.prior
        assert score == pytest.approx(want, abs=5e-3)


def test_classifiers_with_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (8, 0, 1), (9, 0, 1), (None, 1, 0), (11, None, None), (99, 1, 0)], "doc_id bigint, toxic int, quality int")
    for fn in (op1_gated_toxicity.toxicity, op7_neighbour_quality.quality):
        got = fn(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert fn(empty, labels).count() == 0
        assert {r.score for r in fn(odd, labels.limit(0)).collect()} == {0.0}
    out = op1_gated_toxicity.without_toxic(odd, labels.limit(0))
    assert out.columns == odd.columns and out.count() == odd.count()


def odd_texts(seed, n):
    draw = random.Random(seed)
    fixed = ["", " ", "  a", "a  b   c", "\n\n\ta", "▁x ▁▁", "日本語のテキスト", "e" * 3000, "<s></s><unk><0x0A>", "\x00a", "it's we'll '", "a\x1cb\x1d c", "x\x85y\xa0 z", "<|endoftext|>a <|endoftext|>", "ab " * 500 + "\n\n\n", "a b"]
    letters = "abcdeéü \n\t,.'ſ日😀\x1c▁<>0123"
    return fixed + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 200))) for _ in range(n)]


def test_transducer_counts_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL(op10_transducer_counts.MODEL))
    texts = odd_texts(1, 400)
    want = [len(x) for x in library.encode(texts)]
    machine = op10_transducer_counts.transducer(MODEL(op10_transducer_counts.MODEL))
    assert machine.counts(texts).tolist() == want
    small = op10_transducer_counts.Transducer(machine.scores, most_states=50, most_transitions=50)
    assert [int(small.counts([t])[0]) for t in texts[:60]] == want[:60]  # the table is emptied again and again


def test_long_runs_are_scanned_in_chunks():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL(op10_transducer_counts.MODEL))
    scores, walked = op10_transducer_counts.transducer(MODEL(op10_transducer_counts.MODEL)).scores, []

    class Counting(op10_transducer_counts.Transducer):
        def _walk(self, state, cls, first, length):
            walked.extend(length.tolist())
            return super()._walk(state, cls, first, length)

    draw = random.Random(8)
    texts = ["x" * 40_001, "ab" * 20_000, "".join(draw.choice("etaoinshr") for _ in range(40_000)), "=-" * 9_000 + "e" * 9_000]
    texts += ["".join(draw.choice("ABCDEFabcdef0123456789+/") for _ in range(40_000)), " " * 30_000, "a" * 100]
    want = [len(x) for x in library.encode(texts)]
    for chunk in (100, 1024):
        walked.clear()
        machine = Counting(scores, chunk=chunk)
        assert machine.counts(texts).tolist() == want
        assert [int(machine.counts([t])[0]) for t in texts] == want
        assert max(walked, default=0) <= chunk  # no run is read by characters beyond a chunk


def test_token_counts_query(spark, sf, texts, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL(op10_transducer_counts.MODEL))
    for r in QUERIES["op10_transducer_counts"](spark, sf).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    got = op10_transducer_counts.token_counts(odd.select("doc_id", "rank", "text")).collect()
    by_rank = {r["rank"]: len(library.encode(r.text or "")) for r in odd.collect()}
    assert {r["rank"]: r.n_tokens for r in got} == by_rank
    assert op10_transducer_counts.token_counts(empty).count() == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL(op5_minimum_slack_packing.MODEL))
    own = op5_minimum_slack_packing.Encoder(MODEL(op5_minimum_slack_packing.MODEL), most_words=100)
    for text in odd_texts(2, 600):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts_in_order):
    """Pieces tile their documents, with right ids; sequences are tiled by pieces."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL(op5_minimum_slack_packing.MODEL))
    want = defaultdict(int)
    for d, text in texts_in_order:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing_query(spark, sf, texts):
    rows = QUERIES["op5_minimum_slack_packing"](spark, sf).collect()
    used = check_packed(rows, list(texts.items()))
    assert used <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_packing_odd_rows(odd, empty):
    rows = op5_minimum_slack_packing.packed(odd).collect()
    check_packed(rows, [(r.doc_id, r.text or "") for r in odd.collect()])
    assert op5_minimum_slack_packing.packed(empty).count() == 0


def test_plan_is_fullest_and_whole():
    fullest = op5_minimum_slack_packing.fullest
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randrange(1, 31): draw.randrange(1, 4) for _ in range(6)}
        taken = fullest(counts, 30)
        best = {0}
        for n, c in counts.items():
            c -= n == max(counts)
            best = {s + k * n for s in best for k in range(c + 1) if s + k * n <= 30 - max(counts)}
        assert sum(n * k for n, k in taken.items()) == max(counts) + max(best)
        assert taken[max(counts)] and all(k <= counts[n] for n, k in taken.items())


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x & (2**64 - 1)))[0]


def longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed & (2**64 - 1)).intdigest()
    return signed(seed)


def anchors_by_hand(text):
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    inner = [longs(words[i : i + 2]) for i in range(len(words) - 1)]
    found = [
        (longs(inner[i : i + 4]), i) for i in range(len(words) - 4) if min(inner[i], inner[i + 3]) <= min(inner[i + 1], inner[i + 2])
    ]
    if words and not found:  # no closed run: one anchor for the whole
        found = [(longs(words), 0)]
    best = {}
    for h, place in found:
        h = (h & (2**64 - 1)) >> 24
        best[h] = min(place, best.get(h, place))
    return sorted(best.items())


def likeness_by_hand(a, b):
    a, b = dict(a), dict(b)
    shifts = Counter(a[h] - b[h] for h in a.keys() & b.keys())
    if not a and not b:
        return 1.0
    return sum(n for n in shifts.values() if n > 1 or shifts.total() == 1) / len(a.keys() | b.keys())


def check_fingerprints(rows, pairs):
    """pairs: doc_id, text in order."""
    ahead = pairs[1:] + pairs[:1]
    want = defaultdict(int)
    for (d, text), (_, other) in zip(pairs, ahead, strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, changed = anchors_by_hand(text), anchors_by_hand(edited)
        show = lambda x: " ".join(f"{h << 23 | p:x}" for h, p in x)
        near = [round(likeness_by_hand(own, x), 9) for x in (changed, anchors_by_hand(other))]
        want[(d, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed), *near)] += 1
    got = defaultdict(int)
    for r in rows:
        got[(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))] += 1
    assert got == want


def test_fingerprint_query(spark, sf, texts):
    check_fingerprints(QUERIES["op2_closed_syncmers"](spark, sf).collect(), sorted(texts.items()))


def test_fingerprints_of_odd_rows(odd, empty):
    some = odd.filter("doc_id NOT IN (6, 10) AND doc_id IS NOT NULL")
    pairs = sorted((r.doc_id, r.text or "") for r in some.collect())
    check_fingerprints(op2_closed_syncmers.edited_pairs(some).collect(), pairs)
    rows = op2_closed_syncmers.edited_pairs(odd).collect()
    assert len(rows) == odd.count()
    assert len({r for r in rows if r.doc_id == 6}) == 1  # repeated rows give equal rows
    assert op2_closed_syncmers.edited_pairs(empty).count() == 0
    one = op2_closed_syncmers.edited_pairs(odd.filter("doc_id = 8")).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 1320
    assert odd.select(F.lit(1)).count() == len(rows)


def test_only_texts_without_words_have_no_anchors(spark):
    draw = random.Random(6)
    texts = ["", " \n\t"] + [" ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) for n in (5, 6) * 40]
    texts += ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (70, 90) * 20]  # pieces of 16 characters
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(op2_closed_syncmers.edited_pairs(df).collect(), key=lambda r: r.doc_id)
    assert all((r.fingerprint == "") == (not texts[r.doc_id].strip()) for r in rows)
    assert len({r.fingerprint for r in rows}) == len(rows) - 1  # the two texts without words are alike
    assert rows[0].near_next == 1.0 and all(r.near_next < 1.0 for r in rows[1:])


def closed_runs(words):
    """Run -> place of all runs of five of distinct words whose least pair is the first or the last."""
    hashed = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]
    pairs = [longs(hashed[i : i + 2]) for i in range(len(words) - 1)]
    return {tuple(words[i : i + 5]): i for i in range(len(words) - 4) if min(range(4), key=lambda k: pairs[i + k]) in (0, 3)}


def test_likeness_on_all_anchors_of_long_texts(spark):
    passage = [f"p{i}" for i in range(24)]
    long = [[f"{x}{i}" for i in range(3000)] for x in "abc"]
    long[0][500:500] = long[1][2000:2000] = passage  # under one percent of both
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(long)], "doc_id bigint, text string")
    rows = sorted(op2_closed_syncmers.edited_pairs(df).collect(), key=lambda r: r.doc_id)
    runs = [closed_runs(w) for w in long]
    for r, other in zip(rows, (1, 2, 0), strict=True):
        text, following = " ".join(long[r.doc_id]), " ".join(long[other])
        edited = closed_runs((text[: len(text) - len(text) // 2] + following[: len(text) // 2]).split())
        for got, b in ((r.near_edited, edited), (r.near_next, runs[other])):
            both = runs[r.doc_id].keys() & b.keys()  # all shifts are equal
            assert got == pytest.approx(len(both) / len(runs[r.doc_id].keys() | b.keys()), abs=1e-12)
    assert rows[0].near_next > 0 == rows[1].near_next


def test_places_beyond_the_bits_of_a_fingerprint(spark):
    far = 2**23
    a, b = [(1, far + 1), (2, far + 5), (3, far + 9)], [(1, far + 7), (2, far + 100), (3, far + 1000)]
    df = spark.createDataFrame([(a, b)], "a array<struct<hash:bigint,place:int>>, b array<struct<hash:bigint,place:int>>")
    like = op2_closed_syncmers.likeness(F.col("a"), F.col("b"))
    same = op2_closed_syncmers.likeness(F.col("a"), F.col("a"))
    assert df.select(like, same, op2_closed_syncmers.as_text(F.col("a"))).first()[:] == (0.0, 1.0, "800001.1 1000005.1 1800009.1")
