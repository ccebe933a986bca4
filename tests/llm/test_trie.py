"""The conversation trie against brute force, its parentheses against a plain scan."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from txnrisk.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string"


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(paths):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {n: [] for n in members}
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n in members:
        worth = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += worth
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n],
                   digest(c for c in members[n] if len(paths[c]) == len(n))) for n in members)


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def got(found):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in found.collect())


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 % n + (c % 4 == 0) * 100_000
        turns = [(c, t, rng.choice(["user", "tool", None]), rng.choice(["a", "b", "é" * 9, None, ""])) for t in range(rng.randrange(1, 9))]
        turns[0] = (c, None if rng.random() < 0.3 else 0, "user", "hello")
        rows += turns
    return rows


@pytest.mark.parametrize("shards, fan_in", [(1, 64), (9, 2)])
def test_against_brute_force(spark, shards, fan_in):
    rows = made(shards, 400)
    nodes = trie.trie_nodes(trie.rebuilt(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))), shards, fan_in)
    assert got(nodes) == brute(rebuild(rows))


def test_one_conversation_in_a_third_of_all_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 10)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1000, 5) for t in range(4)]
    rows += [(c, t, "user", f"turn {t if t < 2 else c}") for c in range(5000, 7000, 5) for t in range(4)]
    rows += [(20_000, t, "user", f"turn {t % 4} {t // 70}") for t in range(250)]
    rows += [(20_005, t, "user", f"turn {t % 4} {t // 90}") for t in range(250)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    nodes = trie.trie_nodes(trie.rebuilt(trie.ordered_turns(frame)), 16, 4)
    assert got(nodes) == brute(rebuild(rows))


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "of no conversation"), (1, None, None, None), (1, 2, "user", "x" * 300_000), (6, 0, "user", "base is missing"),
            (7, 0, "a", "bc"), (8, 0, "ab", "c"), (10, 1, "user", "twice"), (10, 1, "user", "twice"), (15, 1, None, ""), (20, 1, "", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "path", "turns", "shard", "depth", "kind", "start", "h"):
        frame = frame.withColumn(name, frame["turn"])
    assert got(trie.conversation_trie(frame)) == brute(rebuild(rows))
    assert trie.conversation_trie(frame.limit(0)).count() == 0
    only = spark.createDataFrame([(c, 0, "u", "t") for c in range(1, 40) if c % 5], SCHEMA)  # no base exists
    assert got(trie.conversation_trie(only)) == brute(rebuild([(r[0], r[1], r[2], r[3]) for r in only.collect()]))


def test_turns_of_one_number_have_one_order(spark):
    rows = [(5, 1, "user", t) for t in "abcdefgh"]
    first = got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert first == got(trie.conversation_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)))


@pytest.mark.parametrize("seed", range(6))
def test_findclose_and_leaf_rank(seed):
    rng = random.Random(seed)
    depth = [0]
    for _ in range(rng.choice([1, 10, 3000, 20_000])):
        depth.append(rng.randint(1, min(depth[-1] + 1, rng.choice([3, 40, 5000]))) if seed % 2 else rng.randint(max(1, depth[-1] - 2), depth[-1] + 1))
    coded = trie.Parentheses.of_preorder(np.asarray(depth))
    stack, want, pairs = [], {}, 0
    for i, bit in enumerate(coded.bits.tolist()):
        if bit:
            stack.append(i)
        else:
            want[stack.pop()] = i
            pairs += bool(coded.bits[i - 1])
    assert not stack
    opened = np.flatnonzero(coded.bits)
    assert coded.findclose(opened).tolist() == [want[i] for i in opened.tolist()]
    assert coded.ranks()[1][-1] == pairs == sum(b <= a for a, b in zip(depth, depth[1:] + [0]))
    bits, minima = coded.packed()
    assert len(bits) <= len(depth) // 4 + 1 and len(minima) == 4 * -(-2 * len(depth) // trie.BLOCK)


def test_shards_keep_their_parentheses(spark):
    paths = trie.rebuilt(trie.ordered_turns(spark.createDataFrame(made(3, 200), SCHEMA)))
    rows = trie.trie_shards(paths, 5).where("kind = 'trie'").collect()
    assert len(rows) == 5
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:2 * r["seq"]]
        assert bits.sum() == r["seq"] and trie.Parentheses(bits.astype(bool)).findclose(np.zeros(1, int))[0] == len(bits) - 1
