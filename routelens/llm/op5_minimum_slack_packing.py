"""Best-fit packing by minimum bin slack.

A document's tokens end with an end mark; longer documents are cut into whole sequences from the end, so
the first piece may be shorter.  How pieces share sequences is decided on the number of pieces of each
length alone, at most one number per length up to the capacity, whatever the size of the table: the
longest length left is fixed, subset sums over the lengths left, kept as bits of an integer, give the
fullest sequence around it, and this combination is taken out as often as the counts allow.  The result
is a list of combinations, each with the ranks, within their lengths, of the pieces that it takes.

Tasks make the tokens.  Words are looked up in a bounded table and encoded when they are not there.
Pieces get their rank within their length by a range-partitioned sort, so a length that a third of all
pieces have spreads over many tasks; rank and length give sequence and place by arithmetic.

Null text counts as empty: it is one piece, the end mark.  Rows that repeat a doc_id are documents of
their own.  Empty tables give no rows, and other columns are not read.
"""

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, ranked, text_or_empty
from routelens.llm.op10_transducer_counts import model_path
from routelens.plans.shared import materialize

CAPACITY = 1024
END_ID = 2
MODEL = "byte_bpe_50k.json"
#: Words kept with their ids in each worker.
MOST_WORDS = 400_000
#: Longer texts are encoded in parts, cut before a space between words.
CHARS_AT_ONCE = 1_000_000

#: Unicode white space; the byte order behind the printable characters of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WORD = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class WordIds(dict):
    """Ids of words as little-endian 32-bit numbers; encodes what it does not hold."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a byte-level BPE file, word by word: its merges never cross the words of its pattern."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = WordIds(encoding.encode_ordinary, most_words)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ids(self, text: str) -> bytes:
        if self.split and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(text) <= CHARS_AT_ONCE:
            return b"".join(map(self.words.__getitem__, WORD.findall(text)))
        out, at = [], 0
        cut = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        while at < len(text):
            found = cut.search(text, at + CHARS_AT_ONCE)
            end = found.start() if found else len(text)
            out.append(b"".join(map(self.words.__getitem__, WORD.findall(text[at:end]))))
            at = end
        return b"".join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row of ``docs``."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = array("I", [END_ID]).tobytes()

    def run(batches):
        encode = encoder(model_path(model)).ids
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encode(text) + end)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            ids = batch.column(0).take(pa.array(owner, pa.int32()))
            columns = [ids, pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination with the least slack that holds the longest length of ``counts``: length -> how many."""
    longest = max(counts)
    left = capacity - longest
    reach, steps = 1, []  # bit s: the lengths so far can sum to s
    mask = (1 << left + 1) - 1
    for size in sorted(counts, reverse=True):
        most = min(counts[size] - (size == longest), left // size)
        if most <= 0:
            continue
        steps.append((size, most, reach))
        step = 1
        while most > 0:  # so many more at once: 1, 2, 4, ... and the rest
            step = min(step, most)
            reach |= reach << step * size & mask
            most, step = most - step, 2 * step
        if reach >> left & 1:
            break
    total, taken = reach.bit_length() - 1, {longest: 1}
    for size, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if total >= k * size and before >> total - k * size & 1)
        if k:
            taken[size] = taken.get(size, 0) + k
            total -= k * size
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and first rank."""
    counts, used = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        taken = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in taken.items())
        offset = 0
        for n, k in taken.items():
            rows.append((n, used[n], k, sequence, offset))
            offset += n * k
            used[n] += k * times
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, capacity, model), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = ranked(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "by-length")
    rows = plan(counts, capacity)
    keys = rows[:, 0] << 48 | rows[:, 1]

    def run(batches):
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = get["length"].to_numpy(zero_copy_only=False), get["rank"].to_numpy(zero_copy_only=False)
            use = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            nth = rank - use[:, 1]
            get |= {"sequence_id": pa.array(use[:, 3] + nth // use[:, 2]), "offset": pa.array(use[:, 4] + nth % use[:, 2] * length)}
            yield pa.RecordBatch.from_arrays([get[n] for n in names], names=names)

    names = [*cut.columns, "sequence_id", "offset"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return placed.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def op5_minimum_slack_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
