"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A conversation is the path of its turns, each turn 16 bytes of a hash of role and text. Paths are
sorted and cut into shards of neighbours. A shard's trie is coded as balanced parentheses in
preorder: findclose over range min-max blocks of the excess delimits a node's subtree, the rank
of "()" counts its leaves, and sums over the preorder give the rest.

Neighbouring shards share nodes only on their edges: those of a shard's first path and of its
last. These spines stay open. Whatever hangs on them is settled in its shard and added to the
spine node it hangs on, then the spines of 64 shards at a time are merged into a trie of their
own and treated alike, until one is left. No task sees more than a shard or 64 pairs of spines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.session import stage

#: Turns of a shard, and shards or blocks whose spines are merged in one task.
SHARD_TURNS = 200_000
FAN_IN = 64
#: Parentheses of a min-max block.
BLOCK = 64
#: Conversation ids written into one row of a spine node's ends.
IDS = 8192
STEP = 16
_NEVER = np.iinfo(np.int32).max

_NODE = ("n_convs", "conv_id", "own_children", "own_leaves", "own_saved", "nbytes")
_ROWS = pa.schema([
    ("kind", pa.string()), ("shard", pa.int64()), ("seq", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()),
    ("key", pa.binary()), ("parent_key", pa.binary()), *[(n, pa.int64()) for n in _NODE], ("parent_conv_id", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("bits", pa.binary()), ("minima", pa.binary()),
])
_DDL = ", ".join(f"{f.name} {({'int64': 'long'}).get(str(f.type), str(f.type))}" for f in _ROWS)


class Parentheses:
    """Balanced parentheses with the smallest excess of each block and of pairs of blocks above."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int32)
        pad = -len(bits) % BLOCK
        self.excess = np.concatenate([excess, np.full(pad, _NEVER, np.int32)]).reshape(-1, BLOCK)
        self.levels = [self.excess.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.int32(_NEVER))
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    @classmethod
    def of_preorder(cls, depth: np.ndarray) -> Parentheses:
        """From the depth of each node in preorder: before node i stand i opened and i - depth closed ones."""
        bits = np.zeros(2 * len(depth), bool)
        bits[2 * np.arange(len(depth)) - depth] = True
        return cls(bits)

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """Where each of the parentheses opened at these places is closed."""
        out = np.empty(len(opened), np.int64)
        for at in range(0, len(opened), 1 << 16):
            out[at:at + (1 << 16)] = self._findclose(opened[at:at + (1 << 16)])
        return out

    def _scan(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place in each block, past ``after``, where the excess is down to the target; -1 if none."""
        hit = (self.excess[block] <= target[:, None]) & (np.arange(BLOCK) > (after - block * BLOCK)[:, None])
        return np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)

    def _findclose(self, opened: np.ndarray) -> np.ndarray:
        block = opened // BLOCK
        target = self.excess[block, opened % BLOCK] - 1
        out = self._scan(block, opened, target)
        far = np.flatnonzero(out < 0)
        if not len(far):
            return out
        node, want, stopped = block[far], target[far], np.full(len(far), -1)
        for level, low in enumerate(self.levels):  # up, until a block to the right is low enough
            going = stopped < 0
            right = node + 1
            fits = going & (node % 2 == 0) & (right < len(low))
            fits[fits] = low[right[fits]] <= want[fits]
            stopped[fits] = level
            node = np.where(fits, right, np.where(going, node >> 1, node))
        for level in range(len(self.levels) - 1, 0, -1):  # and down to its first block that is
            down = stopped >= level
            left = 2 * node[down]
            node[down] = left + (self.levels[level - 1][left] > want[down])
        out[far] = self._scan(node, node * BLOCK - 1, want)
        return out

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Opened parentheses, and pairs "()" by their opening one, at or before each place."""
        pairs = self.bits & ~np.append(self.bits[1:], True)
        return np.cumsum(self.bits), np.cumsum(pairs)

    def packed(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits, bitorder="little").tobytes(), self.levels[0].astype("<i4").tobytes()


@dataclass
class Nodes:
    """Nodes of a trie in preorder; ``own_*`` sums up what was settled before and hangs on a node itself."""

    depth: list[int]
    digest: list[bytes]
    n_convs: list[int]
    conv_id: list[int]
    own_children: list[int]
    own_leaves: list[int]
    own_saved: list[int]
    nbytes: list[int]

    @classmethod
    def empty(cls) -> Nodes:
        return cls([], [], [], [], [], [], [], [])

    def add(self, depth: int, digest: bytes, *rest: int) -> None:
        self.depth.append(depth)
        self.digest.append(digest)
        for name, value in zip(_NODE, rest):
            getattr(self, name).append(value)

    def parents(self) -> np.ndarray:
        last, out = [0] * (max(self.depth) + 1), []
        for i, d in enumerate(self.depth):
            last[d] = i
            out.append(last[d - 1] if d else -1)
        return np.asarray(out, np.int64)


def _settle(nodes: Nodes, parent: np.ndarray, open_edges: bool) -> tuple[dict[str, np.ndarray], Parentheses]:
    """Figures of every node's subtree, and ``spine``: whether other shards may have the node too.

    Figures of spine nodes are what is known so far; nothing of them is counted in others.
    """
    depth = np.asarray(nodes.depth, np.int64)
    n = len(depth)
    coded = Parentheses.of_preorder(depth)
    opened = 2 * np.arange(n) - depth
    closed = coded.findclose(opened)
    rank, pairs = coded.ranks()
    end = rank[closed]  # of the subtree in preorder
    spine = np.zeros(n, bool)
    if open_edges:
        spine = np.logical_and.accumulate(depth == np.arange(n))
        spine |= end == n  # those around the last node
    own = {name: np.asarray(getattr(nodes, name), np.int64) for name in _NODE}
    kids = np.bincount(parent[1:], minlength=n)
    alone = coded.bits[opened] & ~coded.bits[opened + 1]  # a pair "()"

    def summed(each: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(each)])
        return before[end] - before[:-1]

    # a pair with settled children is not a leaf; their leaves count instead
    leaves = pairs[closed] - pairs[opened] + alone + summed(own["own_leaves"] - (alone & (own["own_children"] > 0)))
    saved = summed((own["n_convs"] - 1) * own["nbytes"] + own["own_saved"])
    out = own | {"n_children": kids + own["own_children"], "n_leaves": leaves, "saved_tokens": saved, "spine": spine}
    hangs = np.flatnonzero(~spine & np.append(False, spine[parent[1:]])) if n > 1 else np.empty(0, np.int64)
    for name, what in (("own_children", 1), ("own_leaves", leaves), ("own_saved", saved)):
        total = own[name].copy()
        np.add.at(total, parent[hangs], what if isinstance(what, int) else what[hangs])
        out[name] = total
    return out, coded


def _keys(nodes: Nodes, parent: np.ndarray, spine: np.ndarray) -> dict[int, bytes]:
    """Names of spine nodes that are the same in every shard."""
    found = {}
    for i in np.flatnonzero(spine).tolist():
        above = found[int(parent[i])] if i else b""
        found[i] = hashlib.blake2b(above + nodes.digest[i], digest_size=STEP).digest()
    return found


def _rows(shard: int, nodes: Nodes, figures: dict[str, np.ndarray], parent: np.ndarray, keys: dict[int, bytes],
          ends: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Spine nodes as they are, the others as done. ``keys``: of all nodes that have one."""
    n, spine = len(nodes.depth), figures["spine"]
    for at in range(0, n, 50_000):
        part = slice(at, min(n, at + 50_000))
        some = range(part.start, part.stop)
        above, now = parent[part], spine[part]
        parent_done = (above >= 0) & ~spine[above]
        columns = {
            "kind": ["spine" if s else "node" for s in now], "shard": [shard] * len(some), "seq": list(some),
            "depth": nodes.depth[part], "digest": [nodes.digest[i] if s else None for i, s in zip(some, now)],
            "key": [keys.get(i) for i in some],
            "parent_key": [keys[p] if p >= 0 and spine[p] and not s else None for p, s in zip(above.tolist(), now)],
            "parent_conv_id": [int(c) if d else None for c, d in zip(figures["conv_id"][above], parent_done)],
            "ends": [ends[i] if ends is not None and not s else None for i, s in zip(some, now)],
        } | {name: figures[name][part] for name in (*_NODE, "n_children", "n_leaves", "saved_tokens")}
        yield _batch(columns, len(some))


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name] if f.name in columns else [None] * n, f.type) for f in _ROWS], schema=_ROWS)


def _common(a: bytes, b: bytes) -> int:
    """Steps that two paths share from the start."""
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b)) // STEP
    k = 0
    while a[k:k + 64 * STEP] == b[k:k + 64 * STEP]:
        k += 64 * STEP
    while a[k:k + STEP] == b[k:k + STEP]:
        k += STEP
    return k // STEP


def _shard(shard: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one shard: rows (path, sizes, conv_id) in order."""
    nodes, ended, path, stack = Nodes.empty(), [], b"", []
    for batch in batches:
        for now, sizes, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if not stack:
                nodes.add(0, b"")
                nodes.nbytes.append(0)
                ended.append([])
                stack = [0]
            k = _common(path, now)
            del stack[k + 1:]
            for j in range(k, len(now) // STEP):
                stack.append(len(nodes.depth))
                nodes.add(j + 1, now[STEP * j:STEP * j + STEP])
                nodes.nbytes.append(sizes[j])
                ended.append([])
            ended[stack[-1]].append(conv)
            path = now
    n = len(nodes.depth)
    if not n:
        return
    parent = nodes.parents()
    count, least = [len(e) for e in ended], [e[0] if e else None for e in ended]
    for i in range(n - 1, 0, -1):
        p = int(parent[i])
        count[p] += count[i]
        if least[p] is None or least[i] < least[p]:
            least[p] = least[i]
    nodes.n_convs, nodes.conv_id = count, least
    nodes.own_children = nodes.own_leaves = nodes.own_saved = [0] * n
    figures, coded = _settle(nodes, parent, open_edges=True)
    spine = figures["spine"]
    keys = _keys(nodes, parent, spine)
    digests = ["" if spine[i] else _digest(e) for i, e in enumerate(ended)]
    yield from _rows(shard, nodes, figures, parent, keys, digests)
    for i, key in keys.items():
        for k in range(0, len(ended[i]), IDS):
            yield _batch({"kind": ["ends"], "shard": [shard], "seq": [k], "key": [key], "ends": [",".join(map(str, ended[i][k:k + IDS]))]}, 1)
    bits, minima = coded.packed()
    yield _batch({"kind": ["trie"], "shard": [shard], "seq": [n], "bits": [bits], "minima": [minima]}, 1)


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _merge(table: pa.Table, block: int, last: bool) -> pa.Table:
    """Spines of neighbouring shards as one trie: its inner nodes settled, its edges open unless it is the last."""
    table = table.sort_by([("shard", "ascending"), ("seq", "ascending")])
    nodes, keys, stack = Nodes.empty(), {}, []
    for r in table.select(["depth", "digest", "key", *_NODE]).to_pylist():
        d = r["depth"]
        if d < len(stack) and nodes.digest[stack[d]] == r["digest"]:  # the same node as in the shard before
            i = stack[d]
            nodes.conv_id[i] = min(nodes.conv_id[i], r["conv_id"])
            for name in ("n_convs", "own_children", "own_leaves", "own_saved"):
                getattr(nodes, name)[i] += r[name]
            continue
        del stack[d:]
        keys[len(nodes.depth)] = r["key"]
        stack.append(len(nodes.depth))
        nodes.add(d, r["digest"], *[r[name] for name in _NODE])
    parent = nodes.parents()
    figures, _ = _settle(nodes, parent, open_edges=not last)
    return pa.Table.from_batches(_rows(block, nodes, figures, parent, keys, None), _ROWS)


def _merging(last: bool):
    def merge(key, table):
        return _merge(table, key[0].as_py(), last)

    return merge


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each node's ids; rows come ordered by node, shard and place, so one row is held at a time."""
    now, state, first, out = None, None, True, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state, first = key, hashlib.sha256(), True
            state.update(ids.encode() if first else b"," + ids.encode())
            first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], ["key", "ends_sha256"])
            out = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: (turn, name, nbytes) in order, ``name`` being 128 bits of sha256 of role and text in hex.

    Texts are hashed where they are read and never shuffled. Turns of one number are ordered by name.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"),
                    F.struct(F.col("turn"), name.alias("name"), F.octet_length(text).alias("nbytes")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(ordered: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that start with up to ``most`` - 1 turns of an earlier one.

    Conversation c gets the first h turns of conversation c - c % ``every`` and, after them, its own turns
    past its first h; h = crc32 of c in decimal, modulo ``most``.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = ordered.select(F.col("conv_id").alias("start"), F.slice("turns", 1, most - 1).alias("head"))
    own = ordered.withColumn("start", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    empty = F.slice("turns", 1, 0)
    path = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(heads, "start", "left").select("conv_id", path.alias("turns"))


def trie_shards(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """Tries of ranges of ``paths`` (conv_id, turns), as rows of several kinds, stored.

    ``trie`` rows hold a shard's parentheses and the smallest excess of its blocks, ``node`` rows what is done,
    ``spine`` rows the nodes that neighbouring shards may have too, ``ends`` rows the conversations that end there.
    """
    spark = paths.sparkSession
    flat = stage(paths.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"),
                              F.transform("turns", lambda t: t["nbytes"]).alias("sizes"), "conv_id"), "trie-paths")
    if shards is None:
        turns = flat.agg(F.sum(F.size("sizes") + 1)).head()[0] or 0
        shards = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // 1000), turns // SHARD_TURNS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _shard(TaskContext.get().partitionId(), batches)

    placed = flat.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return stage(placed.mapInArrow(build, _DDL), "trie-shards")


def trie_nodes(paths: DataFrame, shards: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the prefix trie of ``paths`` (conv_id, turns).

    conv_id (smallest conversation that starts with the node's turns), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (bytes of the turns that need not be repeated in
    the subtree), ends_sha256 (of the ids, ascending, of the conversations that end there). A
    conversation without turns ends at the root. No conversations: no rows. One conversation
    is held whole by a task, as hashes, never as text.
    """
    rows = trie_shards(paths, shards)
    done, spine = [rows.where("kind = 'node'")], rows.where("kind = 'spine'")
    left = (rows.agg(F.max("shard")).head()[0] or 0) + 1
    while True:
        left = -(-left // fan_in)
        last = left == 1
        merged = stage(spine.withColumn("block", F.floor(F.col("shard") / fan_in).cast("long"))
                       .groupBy("block").applyInArrow(_merging(last), _DDL), "trie-spines")
        done.append(merged.where("kind = 'node'"))
        if last:
            break
        spine = merged.where("kind = 'spine'")
    merged_nodes = reduce(DataFrame.unionByName, done[1:])
    chunks = rows.where("kind = 'ends'").select("key", "ends", "shard", "seq")
    ends = (chunks.repartition("key").sortWithinPartitions("key", "shard", "seq").select("key", "ends")
            .mapInArrow(_hashed_ends, "key binary, ends_sha256 string"))
    shared = merged_nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_digest([]))))
    nodes = done[0].withColumn("ends_sha256", F.col("ends")).unionByName(shared)
    above = merged_nodes.where("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    root = nodes.where("depth = 0").select("conv_id").head()  # most nodes may hang on the root: one number, no join
    below = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long"))
    joined = nodes.withColumn("parent_key", F.when(F.col("depth") > 1, F.col("parent_key"))).join(above, "parent_key", "left")
    return joined.select("conv_id", "depth", F.coalesce(below, "parent_conv_id", "_above").alias("parent_conv_id"),
                         "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """``trie_nodes`` of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns without conv_id belong to no conversation. A null turn comes first, null role or text is empty,
    turns of one number are ordered by a hash of role and text, repeated rows are turns of their
    own. Other columns are not read.
    """
    return trie_nodes(rebuilt(stage(ordered_turns(conversations), "ordered-turns")), shards)
