"""The trie of shared conversation prefixes, with double arrays.

A conversation is a path of turn digests (128 bits of role and text).  Conversations are sorted by path over the cluster and cut
into prefix shards, contiguous runs of bounded size, so the members of any node lie side by side, however many copies there are.
Each shard gives its turns dense ids and packs its trie into two arrays: the child of node s by turn t is BASE[s] + t, and it is
there if CHECK of that slot is s.  The shard's conversations are then traversed through the arrays, which yields its nodes.

A node can go on in another shard only if it is on the path of its shard's first or last conversation.  All others are complete.
Those upper nodes carry a key made of their path, and sums over what hangs below them in the shard; the sums of all shards are
merged by key, and one pass over the merged nodes in path order, with a stack, adds up their subtrees.  That pass reads at most
two paths per shard.  The ids that end in a node are hashed in its shard, or, for upper nodes, as a stream of shards' parts, since
SHA-256 has to read them in order.

A conversation's digests (20 bytes a turn, the count of words included) must fit in one row.

Odd rows.  Rows without conv_id belong to no conversation and are left out.  Null role and text are empty.  A null turn comes
first; equal turns come by role, then by digest; repeated rows are turns of their own.  Empty tables give no rows.  Other columns
are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import WORD, text_or_empty
from routelens.plans.shared import broadcast_if_small, materialize

DIGEST, WORDS = 16, 4
SHARED_EVERY, HEADS = 20, 4
#: Turns and conversations of a shard, together.
SHARD = 200_000
#: Places among the free ones at which a family of siblings is tried before it goes to the end.
TRIES = 16
FREE, TAKEN = -1, -2


class DoubleArray:
    """BASE and CHECK of a trie; the root is slot 0."""

    def __init__(self, room: int):
        self.base, self.check = np.zeros(room + 1, np.int64), np.full(room + 1, FREE, np.int64)
        self.check[0], self.end, self.hole = TAKEN, 1, 1

    def _room(self, end: int) -> None:
        if end > self.check.size:
            more = end + self.check.size
            self.base, self.check = (np.concatenate((x, np.full(more, fill, np.int64))) for x, fill in ((self.base, 0), (self.check, FREE)))

    def _fit(self, turns: np.ndarray) -> int:
        """A base at which the slots of ``turns``, ascending, are free."""
        self._room(self.end + int(turns[-1] - turns[0]) + 1)
        while self.hole < self.end and self.check[self.hole] != FREE:
            self.hole += 1
        at, tried = self.hole, 0
        while at < self.end and tried < TRIES:
            if self.check[at] == FREE:
                if (self.check[at - turns[0] + turns] == FREE).all():
                    return at - int(turns[0])
                tried += 1
            at += 1
        return self.end - int(turns[0])

    def add(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Slots of the children; a parent's children are side by side and all come at once."""
        slots = np.empty(parents.size, np.int64)
        begin = np.flatnonzero(np.diff(parents, prepend=-1))
        count = np.diff(begin, append=parents.size)
        for a, n in zip(begin[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            family = turns[a : a + n]
            slots[a : a + n] = self._place(int(parents[a]), self._fit(np.sort(family)), family)
        alone = begin[count == 1]
        if alone.size < 64:
            for a in alone.tolist():
                slots[a] = self._place(int(parents[a]), self._fit(turns[a : a + 1]), turns[a : a + 1])[0]
            return slots
        self._room(self.end + alone.size)  # only children fit anywhere: holes first, then the end
        free = self.hole + np.flatnonzero(self.check[self.hole : self.end + alone.size] == FREE)[: alone.size]
        self.base[parents[alone]], self.check[free], slots[alone] = free - turns[alone], parents[alone], free
        self.end = max(self.end, int(free[-1]) + 1)
        return slots

    def _place(self, parent: int, base: int, turns: np.ndarray) -> np.ndarray:
        slots = base + turns
        self.base[parent], self.check[slots] = base, parent
        self.end = max(self.end, int(slots.max()) + 1)
        return slots

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``turns``; FREE where there is none."""
        at = self.base[states] + turns
        there = (at > 0) & (at < self.end)
        there[there] = self.check[at[there]] == states[there]
        return np.where(there, at, FREE)


def dense_ids(digests: bytes, depth: np.ndarray) -> np.ndarray:
    """An id from 0 for each distinct digest, in the order of first appearance level by level, so siblings lie close."""
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.concatenate(([False], (halves[order][1:] != halves[order][:-1]).any(axis=1))) if order.size else np.zeros(0, bool)
    ids = np.empty(order.size, np.int64)
    ids[order] = np.cumsum(new)
    by_level = ids[np.argsort(depth, kind="stable")]
    first = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    first[by_level[::-1]] = np.arange(by_level.size)[::-1]
    return np.argsort(np.argsort(first))[ids]


def pack(turns: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> DoubleArray:
    """The trie of sorted conversations: ``turns`` end to end, where each begins, and how many each has."""
    trie, states, active = DoubleArray(turns.size), np.zeros(lens.size, np.int64), np.arange(lens.size)
    for d in range(int(lens.max(initial=0))):
        active = active[lens[active] > d]
        parents, turn = states[active], turns[starts[active] + d]
        new = np.ones(active.size, bool)
        new[1:] = (parents[1:] != parents[:-1]) | (turn[1:] != turn[:-1])
        states[active] = trie.add(parents[new], turn[new])[np.cumsum(new) - 1]
    return trie


def traverse(trie: DoubleArray, turns: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The node of every turn, found through BASE and CHECK."""
    nodes, states, active = np.zeros(turns.size, np.int64), np.zeros(lens.size, np.int64), np.arange(lens.size)
    for d in range(int(lens.max(initial=0))):
        active = active[lens[active] > d]
        states[active] = nodes[starts[active] + d] = trie.step(states[active], turns[starts[active] + d])
    return nodes


def _sha(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def path_keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one included."""
    keys = [hashlib.blake2b(b"", digest_size=16).digest()]
    for at in range(0, len(path), DIGEST):
        keys.append(hashlib.blake2b(keys[-1] + path[at : at + DIGEST], digest_size=16).digest())
    return keys


_PART = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends string, key binary, parent_key binary, words bigint, shard bigint, later int"
)
_NAMES = [c.split()[0] for c in _PART.split(", ")]


def shard_nodes(ids: np.ndarray, paths: list[bytes], words: list[bytes], shard: int) -> pa.RecordBatch:
    """The nodes of a shard's sorted conversations; those with a key may go on in other shards."""
    lens = np.array([len(p) // DIGEST for p in paths], np.int64)
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(lens.size), lens)
    depth_at = np.arange(owner.size) - starts[owner] + 1
    turns = dense_ids(b"".join(paths), depth_at)
    trie = pack(turns, starts, lens)
    at = traverse(trie, turns, starts, lens)

    n = trie.end
    depth, words_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth[at], words_of[at] = depth_at, np.frombuffer(b"".join(words), ">i4")
    n_convs, least = np.bincount(at, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids[owner])
    n_convs[0], least[0] = ids.size, ids.min()
    nodes = np.flatnonzero(trie.check[:n] != FREE)
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]

    key, parent_key, later = {}, {}, {}
    for late, row in ((0, 0), (1, ids.size - 1)):
        along = [0, *at[starts[row] : starts[row] + lens[row]].tolist()]
        keys = path_keys(paths[row])
        for d, node in enumerate(along):
            if node not in key:
                key[node], parent_key[node], later[node] = keys[d], keys[d - 1] if d else None, late
    upper = np.zeros(n, bool)
    upper[list(key)] = True

    # Sums of subtrees from the deepest level up, children of upper nodes included, upper nodes themselves not.
    n_children = np.bincount(trie.check[nodes[1:]][~upper[nodes[1:]]], minlength=n)
    leaves = ((n_children == 0) & ~upper).astype(np.int64)
    saved = np.where(upper, 0, (n_convs - 1) * words_of)
    edges = np.searchsorted(depth[nodes], np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(edges[:-1][::-1].tolist(), edges[1:][::-1].tolist(), strict=True):
        level = nodes[a:b]
        level = level[~upper[level]]
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    last = np.zeros(lens.size, np.int64)
    last[lens > 0] = at[(starts + lens - 1)[lens > 0]]
    ends = {}
    begin = np.flatnonzero(np.diff(last, prepend=-1))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), lens.size], strict=True):
        ends[int(last[a])] = ids[a:b].tolist()
    empty, which = _sha(()), nodes.tolist()
    said = [(",".join(map(str, ends[x])) if x in ends else None) if x in key else _sha(ends[x]) if x in ends else empty for x in which]

    above = np.where(nodes > 0, trie.check[nodes], 0)
    inner = ~upper[above] & ~upper[nodes]
    keys_above = [parent_key[x] if x in key else key.get(p) for x, p in zip(which, above.tolist(), strict=True)]
    columns = [
        least[nodes], depth[nodes], pa.array(least[above], mask=~inner), n_convs[nodes], n_children[nodes], leaves[nodes], saved[nodes],
        pa.array(said, pa.string()), pa.array([key.get(x) for x in which], pa.binary()), pa.array(keys_above, pa.binary()),
        words_of[nodes], np.full(nodes.size, shard), np.array([later.get(x, 0) for x in which], np.int32),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_NAMES)


def _shards(most: int):
    """at, conv_id, path, words in order of path -> nodes."""

    def run(batches):
        ids, paths, words, size, first = [], [], [], 0, None
        for batch in batches:
            for at, conv, path, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = at if first is None else first
                ids.append(conv)
                paths.append(path)
                words.append(word)
                size += 1 + len(path) // DIGEST
                if size >= most:
                    yield shard_nodes(np.array(ids, np.int64), paths, words, first)
                    ids, paths, words, size, first = [], [], [], 0, None
        if ids:
            yield shard_nodes(np.array(ids, np.int64), paths, words, first)

    return run


def _pieces(batches):
    """at, conv_id, digest, words in order -> a path and its words for each conversation's run of rows."""
    conv, at, path, words = None, None, [], []

    def piece():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([at], pa.int64()), pa.array([b"".join(path)], pa.binary()), pa.array([b"".join(words)], pa.binary())],
            names=["conv_id", "at", "path", "words"],
        )

    for batch in batches:
        out = []
        for place, c, digest, word in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                if conv is not None:
                    out.append(piece())
                conv, at, path, words = c, place, [], []
            path.append(digest)
            words.append(word.to_bytes(WORDS, "big"))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if conv is not None:
        yield piece()


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path, words: one row per conversation, its turns in order."""
    role = text_or_empty("role")
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text_or_empty())
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST).alias("digest"), F.regexp_count(text_or_empty(), F.lit(WORD)).alias("n"),
    )
    rows = materialize(rows, "turn-digests")
    order = ["conv_id", "turn", "role", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    pieces = placed.select("at", "conv_id", "digest", "n").mapInArrow(_pieces, "conv_id bigint, at bigint, path binary, words binary")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "path", "words"))).alias("parts"))
    joined = [F.expr(f"aggregate(parts, X'', (a, p) -> concat(a, p.{c}))").alias(c) for c in ("path", "words")]
    return whole.select("conv_id", *joined)


def rebuilt(convs: DataFrame, every: int = SHARED_EVERY, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first turns replaced by as many of the conversation that its group shares."""
    convs = materialize(convs, "paths")
    cut = [F.substring(F.col(c), 1, n * (heads - 1)).alias(f"head_{c}") for c, n in (("path", DIGEST), ("words", WORDS))]
    head = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), *cut)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = convs.withColumn("h", h.cast("int"))
    out = own.join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left")

    def new(c: str, n: int):
        first = F.substring(F.coalesce(F.col(f"head_{c}"), F.expr("X''")), F.lit(1), F.col("h") * n)
        return F.concat(first, F.substring(F.col(c), F.col("h") * n + 1, F.greatest(F.octet_length(c) - F.col("h") * n, F.lit(0)))).alias(c)

    return out.select("conv_id", new("path", DIGEST), new("words", WORDS))


def _folded(batches):
    """Upper nodes in path order -> the same with the sums of their subtrees, each when its subtree is over."""
    stack = []

    def close(out: list) -> None:
        node = stack.pop()
        if not node["n_children"]:
            node["n_leaves"] += 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if stack:
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved_tokens"] += node["saved_tokens"]
        out.append({c: node[c] for c in ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")})

    schema = pa.schema([("key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]])
    for batch in batches:
        out = []
        for node in batch.to_pylist():
            while stack and stack[-1]["depth"] >= node["depth"]:
                close(out)
            if stack:
                stack[-1]["n_children"] += 1
            stack.append(node | {"parent_conv_id": stack[-1]["conv_id"] if stack else None})
        yield pa.RecordBatch.from_pylist(out, schema)
    out = []
    while stack:
        close(out)
    yield pa.RecordBatch.from_pylist(out, schema)


def _ends_hashed(batches):
    """key, ends in order of key and shard -> key, hash of all its ends."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_nodes(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, path, words)."""
    convs = materialize(convs, "conversations")
    placed = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("at", F.monotonically_increasing_id())
    parts = materialize(placed.select("at", "conv_id", "path", "words").mapInArrow(_shards(shard), _PART), "shard-nodes")

    upper = parts.filter("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = upper.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"),
        F.min(F.struct("shard", "later")).alias("place"), *sums,
    )
    merged = materialize(merged.select("*", "place.shard", "place.later").drop("place"), "upper-nodes")
    in_order = merged.repartition(1).sortWithinPartitions("shard", "later", "depth").select("key", "conv_id", "depth", "words", "n_convs", "n_children", "n_leaves", "saved_tokens")
    folded = in_order.mapInArrow(_folded, "key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")
    folded = materialize(folded, "folded-nodes")
    ends = upper.filter("ends IS NOT NULL").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    ends = ends.mapInArrow(_ends_hashed, "key binary, ends_sha256 string").withColumnRenamed("key", "of")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = folded.join(ends, F.col("key") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha(()))))

    above = broadcast_if_small(folded).select(F.col("key").alias("of"), F.col("conv_id").alias("above"))
    rest = parts.filter("key IS NULL").join(above, F.col("parent_key") == F.col("of"), "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).withColumn("ends_sha256", F.col("ends"))
    return whole.select(columns).unionByName(rest.select(columns))


def op13_double_array_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS shared,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
             lambda x, i: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
),
rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth
  FROM (
    SELECT c.conv_id, 0 AS part, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.shared AND t.pos <= h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h
  )
),
members AS (
  SELECT conv_id, 0 AS depth, 'root' AS node, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, depth,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)),
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))
  FROM rebuilt
),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, node, depth, max(depth) OVER (PARTITION BY conv_id) AS n FROM members) WHERE depth = n GROUP BY node
),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM members GROUP BY node, depth),
below AS (SELECT DISTINCT a.node AS top, b.node FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
edges AS (SELECT DISTINCT a.node AS parent, b.node FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
children AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent),
sums AS (
  SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
  FROM below JOIN nodes USING (node) LEFT JOIN children c ON c.parent = below.node GROUP BY top
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN edges e ON e.node = n.node LEFT JOIN nodes p ON p.node = e.parent
LEFT JOIN children c ON c.parent = n.node LEFT JOIN ends ON ends.node = n.node
"""
