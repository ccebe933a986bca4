"""Line de-duplication against brute force, and its filters."""

import random

import numpy as np
import pytest

from common import awkward, docs
from txnrisk.llm import line_dedup as dedup

SPACE = " \t\n\v\f\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=20, docs_least=3):
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text); a missing doc_id is smaller than all others."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= docs_least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(found):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()], key=repr)


def made(seed, n):
    rng = random.Random(seed)
    common = ["A line that many documents share, no. %d" % i for i in range(12)] + ["Ünïcödé lines count code points", "zu kurz äöü", "x" * 19, "é" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"a line of document {i} alone, {rng.random()}" for _ in range(rng.randrange(9))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " ", "\x0b", " "]) for x in lines]
        rows.append((rng.choice([None, i, i, i, i, i // 2]), rng.choice([None, "", "\n", "\n".join(lines), "\n".join(lines), "\n".join(lines)])))
    return rows


@pytest.mark.parametrize("bits", [dedup.FILTER_BYTES, 1])
def test_against_brute_force(spark, bits):
    rows = made(bits, 300)
    rows += rows[:40]  # repeated rows
    found = dedup.drop_repeated_lines(docs(spark, rows).repartition(7), filter_bytes=bits)  # a filter of one byte suspects every line
    assert got(found) == brute(rows)


def test_one_line_in_a_third_of_all_rows_and_a_long_text(spark):
    hot = "the line that stands in very many documents"
    rows = [(i, f"{hot}\nbut this one stands in document {i} alone") for i in range(3000)]
    rows += [(5000, "\n".join(f"line {i} of a very long text of its own" for i in range(60_000))), (5001, hot + "\n" + "w" * 2_000_000)]
    assert got(dedup.drop_repeated_lines(docs(spark, rows).repartition(13))) == brute(rows)


def test_awkward_rows_keep_their_other_columns(spark):
    rows = awkward(spark)
    rows = rows.withColumn("n_lines", rows["source"])
    found = dedup.drop_repeated_lines(rows)
    assert found.columns == [*rows.columns, "n_lines_", "n_dropped"]
    assert found.count() == rows.count() and found.where("text is null").count() == 0
    same = lambda df: sorted(map(repr, df.select("doc_id", "lang", "n_lines", "spans").collect()))
    assert same(found) == same(rows)
    assert dedup.drop_repeated_lines(rows.limit(0)).count() == 0


def test_filters_miss_no_repeat_however_small():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    again = hashes[:500]
    filters = dedup.TwoFilters(1 << 18)
    for batch in np.array_split(np.concatenate([hashes, again]), 9):
        filters.add(batch)
    for bits in (1 << 18, 1 << 14, 1 << 10):
        found = dedup.Suspects(1, bits, np.packbits(dedup.folded(filters.twice, bits), bitorder="little"))
        assert found(again).all()
    assert dedup.Suspects(1, 1 << 18, np.packbits(filters.twice, bitorder="little"))(hashes[500:]).mean() < 0.01
    assert filters.twice.sum() <= 600 * dedup.PROBES


def test_documents_without_suspected_lines_are_not_shuffled(spark):
    rows = docs(spark, [(i, f"line {i} stands in one document") for i in range(50)])
    plan = dedup.drop_repeated_lines(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].startswith("Union")  # one branch has no join
