"""Toxicity scores of a bidirectional gated recurrent network with attention pooling, in numpy.

The input at each word is an embedding of the word and the sum of embeddings of its three- and four-byte
pieces, so that forms of a word never seen are known by their parts.  A gated recurrent unit reads each
window of 32 words in both directions; attention weighs its states; their mean gives the window's logit.
Windows start every 16 words and the last one ends with the text, so windows overlap and none is left
out.  A document's logit is its windows' greatest, as a few words make a document toxic.

The first place of each embedding starts as the smoothed log-odds of its word or piece among the labelled
documents; all of it is then trained with the rest: from each toxic document the window that now scores
highest, from each other document the highest and a random one.  Two numbers that turn a document's logit
into a probability are fitted last.

Training sees a bounded sample: at most ``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_BYTES``
bytes each, the first by a hash of doc_id.  Everything is seeded: reruns agree.  Scoring reads every
text whole, in tasks.

Null text counts as empty; a text without words gets the lowest logit of the sample.  Rows that repeat a doc_id
are scored one by one, and labels that do count once, toxic if any is.  Without labels of both kinds
every score is the share of toxic labels, or 0.  Labels, lang, source and doc_id are never inputs.
"""

import functools
import pickle
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, in_pieces, labelled_sample, text_or_empty, with_text_columns
from routelens.llm.words import mix, word_hashes

WINDOW, STRIDE = 32, 16
BUCKETS, DIM, HIDDEN, ATTENTION = 1 << 17, 6, 8, 8
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 65_536
EPOCHS, BATCH, RATE = 4, 128, 0.05
LANES, CHARS_AT_ONCE = 4096, 1_000_000
THRESHOLD = 0.7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Words:
    """The words of some texts: each distinct word's bucket and its pieces' buckets, and the texts as runs of them."""

    def __init__(self, texts: list[str]):
        hashes, self.starts = word_hashes(texts)
        distinct, at, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (mix(distinct) & np.uint64(BUCKETS - 1)).astype(np.int64)
        raw = _LOWER[np.frombuffer(b" ".join([b"", *(t.encode("utf-8", "surrogatepass") for t in texts), b""]), np.uint8)]
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edges[::2][at], edges[1::2][at]
        size = last - first + 2  # with a space on either side
        begin = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(begin[-1]) - np.repeat(begin[:-1] - first + 1, size)
        spelled = raw[place].astype(np.uint64)
        spelled[begin[:-1]] = spelled[begin[1:] - 1] = 32
        pieces, owners = [], []
        owner = np.repeat(np.arange(size.size), size)
        for n in (3, 4):
            if spelled.size < n:
                continue
            code = sum(spelled[i : spelled.size - n + 1 + i] << np.uint64(8 * i) for i in range(n)) + np.uint64(n << 40)
            whole = owner[: code.size] == owner[n - 1 :]
            pieces.append((mix(code[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(owner[: code.size][whole])
        order = np.argsort(np.concatenate([*owners, np.zeros(0, np.int64)]), kind="stable")
        self.pieces = np.concatenate([*pieces, np.zeros(0, np.int64)])[order]
        self.piece_starts = np.searchsorted(np.concatenate([*owners, np.zeros(0, np.int64)])[order], np.arange(size.size))
        self.piece_counts = np.diff(np.append(self.piece_starts, self.pieces.size))

    def pieces_at(self, words: np.ndarray) -> np.ndarray:
        """The places in ``pieces`` of the pieces of the given distinct words, word by word."""
        count = self.piece_counts[words]
        return np.arange(count.sum()) + np.repeat(self.piece_starts[words] - np.cumsum(count) + count, count)

    def inputs(self, word_table: np.ndarray, piece_table: np.ndarray) -> np.ndarray:
        """A row for each distinct word; every word has at least one piece."""
        if not self.word.size:
            return np.zeros((0, 2 * DIM), np.float32)
        sums = np.add.reduceat(piece_table[self.pieces], self.piece_starts, axis=0)
        return np.hstack([word_table[self.word], sums / np.sqrt(self.piece_counts)[:, None].astype(np.float32)])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window's words as places in ``of``, -1 after the end of a short text; and its text."""
        n = np.diff(self.starts)
        each = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
        text = np.repeat(np.arange(n.size), each)
        nth = np.arange(text.size) - np.repeat(np.cumsum(each) - each, each)
        start = np.minimum(nth * STRIDE, np.maximum(n[text] - WINDOW, 0))
        place = start[:, None] + np.arange(WINDOW)
        return np.where(place < n[text][:, None], self.starts[text][:, None] + place, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights, a forward pass over windows in step, and its gradient."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {"bias": np.zeros(1, np.float32), "out": draw(2 * HIDDEN), "att": draw(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION)}
        for d in "fb":
            self.w |= {f"x{d}": draw(2 * DIM, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _read(self, gates: list[np.ndarray], mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States after each word; ``gates`` are the inputs' part of the gates, in reading order."""
        state, out, recurrent = np.zeros((mask.shape[0], HIDDEN), np.float32), [], self.w[f"h{d}"]
        for gate, there in zip(gates, mask.T, strict=True):
            own = state @ recurrent
            zr = _sigmoid(gate[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gate[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            after = new + z * (state - new)
            if keep is not None:
                keep.append((state, z, r, new, own[:, 2 * HIDDEN :]))
            state = after if there.all() else np.where(there[:, None], after, state)
            out.append(state)
        return np.stack(out, 1)

    def logits(self, projected: dict[str, np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """``projected``: the inputs' part of the gates for each distinct word; ``at``: words of windows, -1 for none."""
        mask = at >= 0
        both = []
        for d in "fb":
            order = range(at.shape[1]) if d == "f" else range(at.shape[1] - 1, -1, -1)
            steps = None if keep is None else keep.setdefault(d, [])
            states = self._read([projected[d][at[:, t]] for t in order], mask[:, list(order)], d, steps)
            both.append(states if d == "f" else states[:, ::-1])
        states = np.concatenate(both, 2)
        hidden = np.tanh(states @ self.w["att"] + self.w["att_b"])
        weight = hidden @ self.w["att_v"]
        weight = np.where(mask, weight, -30.0)
        weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(1)
        if keep is not None:
            keep |= {"mask": mask, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["bias"]

    def gradient(self, keep: dict, slope: np.ndarray) -> tuple[dict, dict]:
        """Of the weights, and of the inputs' part of the gates at each place, given each logit's slope."""
        g = {"bias": slope.sum(keepdims=True), "out": keep["pooled"].T @ slope}
        states, weight, hidden, mask = (keep[k] for k in ("states", "weight", "hidden", "mask"))
        d_pooled = slope[:, None] * self.w["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (states * d_pooled[:, None, :]).sum(2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_hidden = d_weight[:, :, None] * self.w["att_v"] * (1 - hidden**2)
        g["att_v"] = (hidden * d_weight[:, :, None]).sum((0, 1))
        g["att"] = np.einsum("btk,bta->ka", states, d_hidden)
        g["att_b"] = d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ self.w["att"].T
        places = {}
        for d in "fb":
            own = d_states[:, :, :HIDDEN] if d == "f" else d_states[:, ::-1, HIDDEN:]
            there = mask if d == "f" else mask[:, ::-1]
            recurrent = self.w[f"h{d}"]
            g[f"h{d}"], carry, at = np.zeros_like(recurrent), np.zeros_like(own[:, 0]), []
            for t in range(own.shape[1] - 1, -1, -1):
                state, z, r, new, own_n = keep[d][t]
                total = carry + own[:, t]
                live = np.where(there[:, t, None], total, 0)
                d_n = live * (1 - z) * (1 - new**2)
                d_z = live * (state - new) * z * (1 - z)
                d_r = d_n * own_n * r * (1 - r)
                into = np.concatenate([d_z, d_r, d_n * r], 1)
                g[f"h{d}"] += state.T @ into
                carry = np.where(there[:, t, None], live * z + into @ recurrent.T, total)
                at.append(np.concatenate([d_z, d_r, d_n], 1))
            at = np.stack(at[::-1] if d == "f" else at, 1)  # by place in the window
            places[d] = at
        return g, places


class Model:
    def __init__(self):
        self.net = Network()
        self.word_table = np.zeros((BUCKETS, DIM), np.float32)
        self.piece_table = np.zeros((BUCKETS, DIM), np.float32)
        self.scale, self.shift, self.lowest, self.constant = 1.0, 0.0, 0.0, None

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """The inputs' part of the gates; a last row stands for no word."""
        padded = np.vstack([inputs, np.zeros((1, 2 * DIM), np.float32)])
        return {d: padded @ self.net.w[f"x{d}"] + self.net.w[f"b{d}"] for d in "fb"}

    def window_logits(self, words: Words, at: np.ndarray) -> np.ndarray:
        projected = self.project(words.inputs(self.word_table, self.piece_table))
        of = np.append(words.of, -1)  # the last place stands for no word
        return np.concatenate([np.zeros(0, np.float32), *(self.net.logits(projected, of[at[i : i + LANES]]) for i in range(0, len(at), LANES))])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = []
        for run in in_pieces(texts, CHARS_AT_ONCE):
            words = Words(run)
            at, text = words.windows()
            top = np.full(len(run), self.lowest)
            found = np.unique(text)
            logits = self.window_logits(words, at)
            if found.size:
                top[found] = np.maximum.reduceat(logits, np.searchsorted(text, found))
            best.append(top)
        return _sigmoid(np.concatenate([np.zeros(0), *best]) * self.scale + self.shift)

    def inputs_of(self, words: Words) -> np.ndarray:
        return words.inputs(self.word_table, self.piece_table)

    def step(self, words: Words, here: np.ndarray, where: np.ndarray, truth: np.ndarray, descend, live) -> None:
        """One step of training on windows whose words are ``here[where]``; -1 in ``here`` is no word."""
        known = here[here >= 0]
        lo = here.size - known.size  # 1 if -1 is there
        part = object.__new__(Words)
        part.word = words.word[known]
        count = words.piece_counts[known]
        part.pieces, part.piece_counts, part.piece_starts = words.pieces[words.pieces_at(known)], count, np.cumsum(count) - count
        inputs = part.inputs(self.word_table, self.piece_table)
        at = where - lo  # -1 for no word
        projected = self.project(inputs)
        keep: dict = {}
        logit = self.net.logits(projected, at, keep)
        slope = ((_sigmoid(logit) - truth) / truth.size).astype(np.float32)
        grads, places = self.net.gradient(keep, slope)
        d_inputs = np.zeros((len(inputs) + 1, 2 * DIM), np.float32)
        padded = np.vstack([inputs, np.zeros((1, 2 * DIM), np.float32)])
        for d in "fb":
            flat = places[d].reshape(-1, 3 * HIDDEN)
            summed = np.zeros((len(padded), 3 * HIDDEN), np.float32)
            np.add.at(summed, at.reshape(-1), flat)
            summed[-1] = 0
            grads[f"x{d}"], grads[f"b{d}"] = padded.T @ summed, summed.sum(0)
            d_inputs += summed @ self.net.w[f"x{d}"].T
        for name, grad in grads.items():
            descend(name, self.net.w[name], grad)
        rows, inverse = np.unique(part.word, return_inverse=True)
        d_word = np.zeros((rows.size, DIM), np.float32)
        np.add.at(d_word, inverse, d_inputs[:-1, :DIM])
        descend("words", self.word_table, d_word * live[0][rows, None], rows)
        per_piece = np.repeat(d_inputs[:-1, DIM:] / np.sqrt(count)[:, None].astype(np.float32), count, axis=0)
        rows, inverse = np.unique(part.pieces, return_inverse=True)
        d_piece = np.zeros((rows.size, DIM), np.float32)
        np.add.at(d_piece, inverse, per_piece)
        descend("pieces", self.piece_table, d_piece * live[1][rows, None], rows)


def _log_odds(words: Words, toxic: np.ndarray, pieces: bool, least: int, at_once: int = 100) -> np.ndarray:
    """Smoothed log-odds of a text's being toxic by bucket of its words or pieces; 0 where fewer than ``least``
    texts have it.  Counts are added up over some texts at a time."""
    pos, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in range(0, toxic.size, at_once):
        starts = words.starts[i : i + at_once + 1]
        owner = np.repeat(np.arange(starts.size - 1), np.diff(starts))
        pairs = np.unique(owner * np.int64(words.word.size) + words.of[starts[0] : starts[-1]])
        text, word = np.divmod(pairs, words.word.size)
        if pieces:
            text, buckets = np.repeat(text, words.piece_counts[word]), words.pieces[words.pieces_at(word)]
        else:
            buckets = words.word[word]
        text, bucket = np.divmod(np.unique(text * np.int64(BUCKETS) + buckets), BUCKETS)
        pos += np.bincount(bucket, toxic[i : i + at_once][text], BUCKETS)
        all_ += np.bincount(bucket, minlength=BUCKETS)
    odds = np.log((pos + 0.5) / (all_ - pos + 0.5)) - np.log(toxic.sum() / (toxic.size - toxic.sum()))
    return np.where(all_ >= least, odds * all_ / (all_ + 5.0), 0).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 1, epochs: int = EPOCHS) -> Model:
    model, rng, toxic = Model(), np.random.default_rng(seed), np.array(labels, np.int64)
    if not 0 < toxic.sum() < toxic.size:
        model.constant = float(toxic.mean()) if toxic.size else 0.0
        return model
    words = Words(texts)
    at, text = words.windows()
    if not len(at):
        model.constant = float(toxic.mean())
        return model
    model.word_table[:, 1:] = rng.normal(0, 0.02, (BUCKETS, DIM - 1))
    model.piece_table[:, 1:] = rng.normal(0, 0.02, (BUCKETS, DIM - 1))
    model.word_table[:, 0] = _log_odds(words, toxic, False, 3)
    model.piece_table[:, 0] = _log_odds(words, toxic, True, 5)
    # A bucket that too few texts have is no evidence at all, now and after training.
    live_word, live_piece = model.word_table[:, 0] != 0, model.piece_table[:, 0] != 0
    model.word_table[~live_word], model.piece_table[~live_piece] = 0, 0

    squares: dict = {}

    def descend(name: str, weights: np.ndarray, grad: np.ndarray, rows=None) -> None:
        s = squares.setdefault(name, np.full_like(weights, 1e-6))
        if rows is None:
            s += grad**2
            weights -= RATE * grad / np.sqrt(s)
        else:
            s[rows] += grad**2
            weights[rows] -= RATE * grad / np.sqrt(s[rows])

    has, first = np.unique(text, return_index=True)
    last = np.append(first[1:], text.size)
    of = np.append(words.of, -1)
    for epoch in range(epochs):
        # The first choice is by the log-odds alone, later ones by the network.
        if epoch == 0:
            odds = np.append(model.word_table[words.word, 0] + model.inputs_of(words)[:, DIM], -9)
            logit = odds[of[at]].max(1)
        else:
            logit = model.window_logits(words, at)
        top = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(first, last, strict=True)])
        any_ = first + (rng.random(first.size) * (last - first)).astype(np.int64)
        chosen = np.concatenate([top, any_[toxic[has] == 0]])
        truth = np.concatenate([toxic[has], np.zeros(int((toxic[has] == 0).sum()), np.int64)]).astype(np.float32)
        order = rng.permutation(chosen.size)
        for i in range(0, chosen.size, BATCH):
            pick = order[i : i + BATCH]
            here, where = np.unique(of[at[chosen[pick]]], return_inverse=True)
            model.step(words, here, where.reshape(len(pick), WINDOW), truth[pick], descend, (live_word, live_piece))
    logit = model.window_logits(words, at)
    best = np.maximum.reduceat(logit, first).astype(np.float64)
    model.scale, model.shift = _calibrate(best, toxic[has])
    model.lowest = float(best.min())
    return model


def _calibrate(logit: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logits probabilities: logistic regression by Newton's method."""
    x, w = np.stack([logit, np.ones_like(logit)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (truth - p) - 1e-3 * w), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


@functools.lru_cache(2)
def _unpacked(data: bytes) -> Model:
    return pickle.loads(zlib.decompress(data))


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled documents (labels: doc_id, toxic), from a bounded sample of them."""
    rows = labelled_sample(docs, labels, F.max("toxic"), most, most_bytes)
    return train([r.text for r in rows], [r.label for r in rows])


def scored(docs: DataFrame, model: Model, name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (any columns, and text) with a score, in place of text or beside it."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))
    return with_text_columns(docs, lambda texts: [_unpacked(shared.value).scores(texts)], f"{name} double", keep_text)


def held_out(parts: int, part: int):
    """Whether crc32 of doc_id as text leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == part


def toxicity(docs: DataFrame, labels: DataFrame, seen=None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; learns from the labels whose doc_id meets ``seen``."""
    model = learned(docs, labels if seen is None else labels.filter(seen))
    out = scored(docs.select("doc_id", text_or_empty().alias("text")), model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, seen=None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    model = learned(docs, labels if seen is None else labels.filter(seen))
    return scored(docs, model, "_toxicity_of_row", keep_text=True).filter(F.col("_toxicity_of_row") < THRESHOLD).drop("_toxicity_of_row")


def op1_gated_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(documents(spark, sf_dir), labels, ~held_out(3, 1))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
