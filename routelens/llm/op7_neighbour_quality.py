"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document is counted as terms: hashed words, the shapes of its words (first and last characters' kinds
and length), hashed pairs of bytes, and words that come again within four words.  Counts are damped,
weighted by how rare the term is among the labelled documents, scaled to length one, and projected to
the leading singular directions of the labelled documents.  Every document is multiplied with all
labelled vectors, a block of documents at a time, and its nine nearest labelled documents vote with
the fourth power of their cosine as weight.

The labelled vectors are a bounded sample: at most ``SAMPLE_DOCS`` labelled documents of at most
``SAMPLE_BYTES`` bytes each, the first by a hash of doc_id.  They, the term weights and the directions
are a few megabytes at any size of the table, and are broadcast.  Scoring reads every text whole.

Null text counts as empty; a text without terms gets the share of good labels.  Rows that repeat a doc_id
are scored one by one, labels that do count once, good only if all are.  Without labels every score is 0.
Labels, lang, source and doc_id are never inputs.
"""

import functools
import pickle
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, in_pieces, labelled_sample, text_or_empty, with_text_columns
from routelens.llm.op1_gated_toxicity import held_out
from routelens.llm.words import mix, word_hashes

WORD_TERMS, PAIR_TERMS, NEAR = 1024, 1024, 4
KINDS, LENGTHS = 5, 8
DIRECTIONS, NEIGHBOURS, SHARPNESS = 32, 9, 4
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 65_536
CHARS_AT_ONCE, BLOCK = 1_000_000, 512
THRESHOLD = 0.7
SHAPE_TERMS = KINDS**3 * LENGTHS
TERMS = WORD_TERMS + PAIR_TERMS + SHAPE_TERMS + NEAR

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Kinds of bytes: 0 small letter, 1 capital, 2 digit, 3 other ASCII, 4 beyond ASCII.
_KIND = np.full(256, 3, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_PAIR = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_TERMS)).astype(np.int64)


def term_counts(texts: list[str]) -> np.ndarray:
    """A row of term counts for each text."""
    words, starts = word_hashes(texts)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    size = len(texts)
    of_byte = np.repeat(np.arange(size), [len(d) + 1 for d in data])
    of_word = np.repeat(np.arange(size), np.diff(starts))
    pairs = _PAIR[raw[1:-1].astype(np.int64) << 8 | raw[2:]] if raw.size > 2 else np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[::2], edges[1::2] - 1
    shape = (_KIND[raw[first]] * KINDS + _KIND[raw[last]]) * KINDS + _KIND[raw[np.maximum(last - 1, first)]]
    shape = shape * LENGTHS + np.minimum(last - first, LENGTHS - 1)
    parts = [
        (of_word, (words % np.uint64(WORD_TERMS)).astype(np.int64)),
        (of_word, WORD_TERMS + shape),
        (of_byte[: pairs.size], WORD_TERMS + SHAPE_TERMS + pairs),
    ]
    for k in range(1, NEAR + 1):
        again = np.flatnonzero((words[k:] == words[:-k]) & (of_word[k:] == of_word[:-k]))
        parts.append((of_word[again], np.full(again.size, TERMS - k)))
    out = np.zeros(size * TERMS, np.int64)
    for row, term in parts:
        out += np.bincount(row * TERMS + term, minlength=out.size)
    return out.reshape(size, TERMS)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


class Neighbours:
    def __init__(self, texts: list[str], labels: list[int], neighbours: int = NEIGHBOURS):
        self.labels, self.neighbours = np.array(labels, np.float64), min(neighbours, len(labels))
        self.prior = float(self.labels.mean()) if labels else 0.0
        if not labels:
            return
        counts = np.vstack([term_counts(run).astype(np.float32) for run in in_pieces(texts, CHARS_AT_ONCE)])
        seen = (counts > 0).sum(0)
        self.rarity = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
        weighted = self._weigh(counts)
        self.directions = self._leading(weighted, min(DIRECTIONS, len(labels)))
        self.vectors = _unit(weighted @ self.directions)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.rarity)

    @staticmethod
    def _leading(matrix: np.ndarray, n: int) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a fixed start."""
        basis = np.random.default_rng(3).normal(size=(matrix.shape[1], n + 8)).astype(np.float32)
        for _ in range(5):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        return np.ascontiguousarray(basis @ np.linalg.svd(matrix @ basis, full_matrices=False)[2].T[:, :n])

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for run in in_pieces(texts, CHARS_AT_ONCE):
            if self.labels.size == 0:
                out.append(np.zeros(len(run)))
                continue
            for i in range(0, len(run), BLOCK):
                vectors = _unit(self._weigh(term_counts(run[i : i + BLOCK])) @ self.directions)
                out.append(self._votes(vectors @ self.vectors.T))
        return np.concatenate(out)

    def _votes(self, cosines: np.ndarray) -> np.ndarray:
        nearest = np.argpartition(-cosines, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        votes = (weight * self.labels[nearest]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, votes, self.prior), 0, 1)


@functools.lru_cache(2)
def _unpacked(data: bytes) -> Neighbours:
    return pickle.loads(zlib.decompress(data))


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> Neighbours:
    """The labelled vectors (labels: doc_id, quality), of a bounded sample of the labelled documents."""
    rows = labelled_sample(docs, labels, F.min("quality"), most, most_bytes)
    return Neighbours([r.text for r in rows], [r.label for r in rows])


def quality(docs: DataFrame, labels: DataFrame, seen=None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; learns from the labels whose doc_id meets ``seen``."""
    model = learned(docs, labels if seen is None else labels.filter(seen))
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))
    text = docs.select("doc_id", text_or_empty().alias("text"))
    out = with_text_columns(text, lambda texts: [_unpacked(shared.value).scores(texts)], "score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality(documents(spark, sf_dir), labels, ~held_out(4, 2))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
