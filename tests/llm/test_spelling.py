"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest

from common import awkward, docs
from txnrisk.llm import spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows):
    out = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1:])


def brute(words):
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(found[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(found):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect())


def vocabulary(seed, n):
    """Words with many near ones: few letters, doubled letters, chains of edits, letters beyond ASCII."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aabß") for _ in range(rng.randint(5, 8))) for _ in range(n)}
    for w in list(words):
        for _ in range(3):
            at = rng.randrange(len(w))
            words.add(rng.choice([w[:at] + rng.choice("abÿ÷") + w[at:], w[:at] + w[at + 1:], w[:at] + "é" + w[at + 1:]]))
    return {w: rng.choice([3, 3, 4, 6, 12, 50, 99]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("shards", [1, 2, 13])
def test_neighbours_against_brute_force(spark, shards):
    words = vocabulary(shards, 150)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = {r["word"]: r for r in spelling.neighbours(frame, shards).collect()}
    name = {r["id"]: r["word"] for r in found.values()}
    assert sorted(name, key=name.get) == sorted(name)
    assert found.keys() == words.keys()
    for w in words:
        vs = [v for v in words if near(w, v)]
        assert found[w]["n_near"] == len(vs)
        assert name.get(found[w]["best"]) == min(vs, key=lambda v: (-words[v], v), default=None)


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    words = list(vocabulary(4, 60).items())
    rows = [(rng.choice([None, i, i, i]), " ,1\n-".join(rng.choices([w.upper() if rng.random() < 0.3 else w for w, _ in words], [n for _, n in words], k=80)))
            for i in range(150)] + [(900, None), (901, ""), (902, "x" * 30_000 + " " + "ab" * 20_000)] * 3
    found = spelling.spelling_variants(docs(spark, rows).repartition(5))
    want = brute(counted(rows))
    assert sum(r[1] is not None and r[2] != r[1] for r in want) > 5  # chains of forms
    assert got(found) == want


def test_one_word_in_a_third_of_all_rows_and_awkward_rows(spark):
    rows = [(i, "common " * 20 + random.Random(i).choice(["comon", "commmon", "kommon", "other"])) for i in range(900)]
    assert got(spelling.spelling_variants(docs(spark, rows).repartition(9))) == brute(counted(rows))
    odd = awkward(spark)
    odd = odd.withColumn("word", odd["doc_id"]).withColumn("n", odd["text"])
    found = spelling.spelling_variants(odd)
    assert got(found) == brute(counted([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_a_prefix_has_one_number_in_all_shards(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    cuts = sorted(rng.sample(range(1, len(words)), rng.randint(0, 30)))
    shards = {k * 3: words[a:b] for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)]))}
    owners = spelling._owners([(k, ws[0], ws[-1]) for k, ws in shards.items()])
    number, name = {}, {}
    for k, ws in shards.items():
        for w, nodes in zip(ws, spelling._number(k, ws, owners[k])):
            for j, node in enumerate(nodes):
                assert number.setdefault(w[:j], node) == node and name.setdefault(node, w[:j]) == w[:j]
