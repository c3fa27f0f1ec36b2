"""Token counts by a finite-state transducer compiled from a byte-fallback BPE vocabulary.

The last token of a prefix's tokenization decides the rest: a tokenization is right exactly when all
adjacent pairs of its tokens are, and a pair is right when merging its two tokens' characters gives the
two again.  So a deterministic automaton can read a text character by character.  Its state holds, for
each end of the prefix that may still grow into a token, the token before that end and how many tokens
fewer the prefix had there.  Each transition carries the change in the number of tokens, which is
negative where a longer token takes the place of several.

States and transitions are compiled as texts need them, into a hash table of fixed bounds that is
emptied when it is full.  Tokens never cross a white-space mark that starts a word, nor a character that
the vocabulary lacks: there every state leads to the start state, so the state map of a run between two
such places is constant, and composing the maps of all runs is a sum of their counts.  Runs of a batch are
read in step, one array operation per character place.  The last few long ones are cut into chunks, whose
state maps, for the states that they may start in, are composed by a parallel prefix scan.

Null text counts as empty and has no tokens.  Texts of any length are read whole.  Every row gives one
row; other columns are not read.
"""

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, in_pieces, text_or_empty, with_text_columns

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"
#: Bounds of the compiled table, and the characters that are counted together.
MOST_STATES, MOST_TRANSITIONS, CHARS_AT_ONCE = 400_000, 1_500_000, 2_000_000
#: Characters of a chunk of a long run, those before it that its first guess reads, and rounds of making its map.
CHUNK, WARM, ROUNDS = 1024, 64, 32
SINGLE = 4
#: An end with at most so many tokens to grow into is told apart by which of them fit, not by the token before it.
FEW = 8


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    def __init__(self, scores: dict[str, float], most_states: int = MOST_STATES, most_transitions: int = MOST_TRANSITIONS, chunk: int = CHUNK):
        self.scores, self.chunk = scores, chunk
        self.most_states, self.most_transitions = most_states, most_transitions
        self.tokens = {t for t in scores if self._merge(t) == [t]}
        grows: dict[str, list[str]] = {}
        for t in sorted(self.tokens):
            for i in range(1, len(t)):
                grows.setdefault(t[:i], []).append(t)
        self.grows = grows
        self.classes = np.zeros(0x110000, np.int32)  # 0: not in the vocabulary
        self.chars = ["", *sorted({t for t in scores if len(t) == 1})]
        for i, c in enumerate(self.chars):
            if c:
                self.classes[ord(c)] = i
        self.history: dict[str, list] = {}
        self._empty()

    # Pairs of tokens.

    def _merge(self, s: str) -> list[str]:
        parts = list(s)
        while True:
            found = [(-self.scores[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _merges(self, token: str) -> list[tuple[float, str, str]]:
        """Each merge that makes a token: its score, and the first and last part after it."""
        got = self.history.get(token)
        if got is None:
            parts, got = list(token), [(np.inf, token[0], token[-1])]
            while len(parts) > 1:
                s, i = min((-self.scores[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.scores)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                got.append((-s, parts[0], parts[-1]))
            self.history[token] = got
        return got

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b gives a and b: no merge across them ever comes first."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            left, right, i, j, got = self._merges(a), self._merges(b), 0, 0, True
            while got:
                across = self.scores.get(left[i][2] + right[j][1])
                next_left = left[i + 1][0] if i + 1 < len(left) else -np.inf
                next_right = right[j + 1][0] if j + 1 < len(right) else -np.inf
                if across is not None and across > next_left and across >= next_right:
                    got = False
                elif next_left == next_right == -np.inf:
                    break
                elif next_left >= next_right:  # ties go to the left
                    i += 1
                else:
                    j += 1
            self.pairs[key] = got
        return got

    # States: tuples of (end, what came before it, tokens fewer), longest end first.

    def _empty(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.entries: dict[tuple, tuple] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.bits = 16
        self._resize()
        self.start = self._number((("", None, 0),))

    def _resize(self, keys=(), to=(), emits=()) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)
        self.n = 0
        for k, s, e in zip(keys, to, emits, strict=True):
            self._put(int(k), int(s), int(e))

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def _put(self, key: int, to: int, emit: int) -> None:
        at, mask = self._slot(key), (1 << self.bits) - 1
        while self.keys[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.to[at], self.emits[at] = key, to, emit
        self.n += 1

    def _number(self, state: tuple) -> int:
        i = self.numbers.get(state)
        if i is None:
            i = self.numbers[state] = len(self.states)
            self.states.append(state)
        return i

    def _fit_after(self, before, token: str, end: str) -> bool:
        if before is None:
            return True
        if isinstance(before, int):
            return bool(before >> self.grows[end].index(token) & 1)
        return self.fits(before, token)

    def _compile(self, key: int) -> tuple[int, int]:
        """The transition of a state and a character's class; puts it into the table."""
        number, cls = divmod(key, len(self.chars))
        c, state = self.chars[cls], self.states[number]
        end, before, fewer = next(x for x in state if x[0] + c in self.tokens and self._fit_after(x[1], x[0] + c, x[0]))
        emit, last = fewer + 1, end + c
        ahead = []
        for end, before, fewer in (*state, ("", last, emit)):
            grown = end + c if (end, before, fewer) != ("", last, emit) else ""
            if not grown:
                entry = ("", last, 0)
            elif grown not in self.grows:
                continue
            else:
                entry = (grown, self._what_fits(end, before, grown), fewer - emit)
                if entry[1] == 0:
                    continue
            ahead.append(self.entries.setdefault(entry, entry))
        to = self._number(tuple(ahead))
        if self.n * 2 > 1 << self.bits:
            used = np.flatnonzero(self.keys >= 0)
            old = self.keys[used], self.to[used], self.emits[used]
            self.bits += 1
            self._resize(*old)
        self._put(key, to, emit)
        return to, emit

    def _what_fits(self, end: str, before, grown: str):
        """``before``, or where few tokens are left to grow into, which of these fit after it, as bits."""
        if len(self.grows[grown]) > FEW:
            return before
        bits = sum(self._fit_after(before, t, end) << i for i, t in enumerate(self.grows[grown]))
        return None if bits == (1 << len(self.grows[grown])) - 1 else bits

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while True:
            at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            there = self.keys[at]
            off = np.flatnonzero(there != keys)
            missing = []
            while off.size:
                absent = there[off] < 0
                missing.append(keys[off[absent]])
                off = off[~absent]
                at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
                there[off] = self.keys[at[off]]
                off = off[there[off] != keys[off]]
            new = np.unique(np.concatenate(missing)) if missing else ()
            if not len(new):
                return self.to[at], self.emits[at]
            for k in new:
                self._compile(int(k))

    # Texts.

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._counts(run) for run in in_pieces(texts, CHARS_AT_ONCE))])

    def _counts(self, texts: list[str]) -> np.ndarray:
        if len(self.states) > self.most_states or self.n > self.most_transitions:
            self._empty()
        marked = [MARK + t if t else "" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code == 32, ord(MARK), code)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in marked])
        cls = self.classes[code]
        known = cls > 0
        outside = doc[~known]
        width = 1 + (code[~known] > 0x7F).astype(np.int64) + (code[~known] > 0x7FF) + (code[~known] > 0xFFFF)
        total = np.bincount(outside, width, len(texts)).astype(np.int64)  # a token for each byte

        mark = code == ord(MARK)
        fresh = known.copy()  # chunks start here
        fresh[1:] &= (doc[1:] != doc[:-1]) | ~known[:-1] | (mark[1:] & ~mark[:-1])
        cls, first = cls[known].astype(np.int64), np.flatnonzero(fresh[known])
        if not first.size:
            return total
        length = np.diff(np.append(first, cls.size))
        _, count = self._read(np.full(first.size, self.start, np.int64), cls, first, length, self._scan)
        return total + np.bincount(doc[known][first], count, len(texts)).astype(np.int64)

    def _read(self, state: np.ndarray, cls: np.ndarray, first: np.ndarray, length: np.ndarray, rest=None):
        """The states that runs of characters lead to from ``state``, and their counts; ``rest`` reads the last few."""
        order = np.argsort(-length, kind="stable")
        state, first, length, count = state[order], first[order], length[order], np.zeros(first.size, np.int64)
        running = np.searchsorted(-length, -np.arange(length[0]), "left")  # runs longer than each place
        for place in range(int(length[0])):
            n = int(running[place])
            if n < 16 and place > 64:
                state[:n], more = (rest or self._walk)(state[:n], cls, first[:n] + place, length[:n] - place)
                count[:n] += more
                break
            to, emit = self._look_up(state[:n] * len(self.chars) + cls[first[:n] + place])
            state[:n] = to
            count[:n] += emit
        back = np.argsort(order)
        return state[back], count[back]

    def _scan(self, state: np.ndarray, cls: np.ndarray, first: np.ndarray, length: np.ndarray):
        """As ``_read``, for long runs: the state maps of their chunks, composed by a parallel prefix scan.

        A chunk's map is made for the states that it may start in: at first what the characters before it lead
        to from the start state, then all that the map before it gives, and after ``SINGLE`` rounds also what
        the run's own state has come to, until the maps from that state to the run's end are whole.  After
        ``ROUNDS``, what is left of a run is read by characters.
        """
        pieces = -(-length // self.chunk)
        run, head = np.repeat(np.arange(first.size), pieces), np.cumsum(pieces) - pieces
        at = (np.arange(run.size) - head[run]) * self.chunk
        begin, size = first[run] + at, np.minimum(self.chunk, length[run] - at)
        last, inner = at + size == length[run], np.flatnonzero(at)
        new = state[run]
        if inner.size:
            before = np.full(inner.size, min(WARM, self.chunk))
            new[inner] = self._read(np.full(inner.size, self.start, np.int64), cls, begin[inner] - before, before)[0]
        new = np.arange(run.size) << 32 | new  # a chunk and a state it starts in
        keys, to, count = np.zeros((3, 0), np.int64)
        for done in range(ROUNDS):
            made = self._read(new & 0xFFFFFFFF, cls, begin[new >> 32], size[new >> 32])
            keys, to, count = (np.concatenate(x) for x in ((keys, new), (to, made[0]), (count, made[1])))
            order = np.argsort(keys)
            keys, to, count = keys[order], to[order], count[order]
            chunk = keys >> 32
            goal = np.where(last[chunk], -1, (chunk + 1) << 32 | to)
            after = np.minimum(np.searchsorted(keys, goal), keys.size - 1)
            known = keys[after] == goal
            jump, upto = np.where(known, after, np.arange(keys.size)), np.where(known, count, 0)
            for _ in range(int(pieces.max()).bit_length()):  # each map composed with the one it leads to
                upto, jump = upto + upto[jump], jump[jump]
            starts = np.searchsorted(keys, head << 32 | state)
            ends = jump[starts]
            if last[chunk[ends]].all():
                break
            new = np.unique(goal[~known & (goal >= 0)])
            if done >= SINGLE:  # a state that goes on, as in a run of one character, is tried in all later chunks
                lacking = [(g >> 32, g & 0xFFFFFFFF) for g in goal[ends[~last[chunk[ends]]]]]
                new = np.concatenate([np.arange(c, head[run[c]] + pieces[run[c]]) << 32 | s for c, s in lacking])
                new = np.setdiff1d(new, keys)
        state, total = to[ends], upto[starts] + count[ends]
        cut = np.flatnonzero(~last[chunk[ends]])
        if cut.size:
            place = begin[chunk[ends[cut]] + 1]
            state[cut], more = self._walk(state[cut], cls, place, first[cut] + length[cut] - place)
            total[cut] += more
        return state, total

    def _walk(self, state: np.ndarray, cls: np.ndarray, first: np.ndarray, length: np.ndarray):
        """As ``_read``, a character at a time."""
        out, seen = [], {}
        for s, a, n in zip(state.tolist(), first.tolist(), length.tolist(), strict=True):
            total = 0
            for c in cls[a : a + n].tolist():
                key = s * len(self.chars) + c
                got = seen.get(key)
                if got is None:
                    to, emit = self._look_up(np.array([key], np.int64))
                    got = seen[key] = int(to[0]), int(emit[0])
                s, emit = got
                total += emit
            out.append((s, total))
        return np.array(out, np.int64).reshape(-1, 2).T


@functools.cache
def transducer(path: str) -> Transducer:
    """The automaton of a vocabulary file, one in each worker process."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only vocabularies that keep texts as they are, after one leading space, are supported")
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError("only BPE with byte fallback is supported")
    scores = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)}
    if any(MARK in t.lstrip(MARK) for t in scores):
        raise ValueError("a token that goes on after a white-space mark would cross chunks")
    return Transducer(scores)


def token_counts(df: DataFrame, model: str = MODEL) -> DataFrame:
    """``df`` (any columns, and text) with n_tokens in place of text."""
    return with_text_columns(df, lambda texts: [transducer(model_path(model)).counts(texts)], "n_tokens bigint")


def op10_transducer_counts(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    out = token_counts(docs.withColumn("n_bytes", F.octet_length("text").cast("long")))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
