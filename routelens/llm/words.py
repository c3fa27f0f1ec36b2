"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

import functools
import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A random odd number for each byte, the same for A-Z and a-z and 0 for white space.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
#: Words are hashed as many at a time as have 2**BITS bytes, and a longer one alone.
BITS = 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return tuple(both)


def word_hashes(texts: list[str], digest_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin (and the last end).

    The hash is a polynomial modulo 2**64, for which unequal long words of one hash can be written down.  Where equal hashes
    must mean equal words, words of ``digest_from`` bytes or more get a BLAKE2 digest instead.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    ends = np.cumsum([0, *(len(d) + 1 for d in data)])
    if not first.size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes, i = np.zeros(first.size, np.uint64), 0
    while i < first.size:  # whole words, of at most some bytes together
        j = max(i + 1, int(np.searchsorted(last, first[i] + (1 << BITS), "right")))
        at = first[i:j] - first[i]
        power, inverse = _powers(max(BITS, int(last[j - 1] - first[i]).bit_length()))
        part = raw[first[i] : last[j - 1]]
        hashes[i:j] = np.add.reduceat(_BYTE[part] * power[: part.size], at) * inverse[at]
        i = j
    out = mix(hashes + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first >= digest_from).tolist() if digest_from else ():
        word = raw[first[i] : last[i]].tobytes().lower()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, np.searchsorted(first, ends)


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, or of all its words where it has fewer; and where each text's begin."""
    count = np.diff(starts)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(count.size), size)
    at = starts[owner] + np.arange(begin[-1]) - begin[owner]
    have = np.minimum(count, n)[owner]
    out = np.zeros(at.size, np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for i in range(n):
        out = np.where(have > i, mix(out * np.uint64(3) + padded[at + i]), out)
    return out, begin


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending."""
    values = values.copy()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(values.size, bool)
    new[1:] = values[1:] != values[:-1]
    new[starts[:-1][np.diff(starts) > 0]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[starts]
