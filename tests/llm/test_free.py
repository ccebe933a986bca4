"""Extraction, search, language, near-duplicates and the pipeline against brute force and planted cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from common import awkward, docs, table
from txnrisk.llm import extraction, language, near_duplicates as near, queries, vectors

BODY = "The first paragraph of the article is long enough, with commas, to score well. "


def page(inner, head="<title>No</title><style>p{x:y}</style><script>var a='<p>no, no, no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{inner}</body></html>"


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"),
    (page(f"<nav><a href=/>Menu</a></nav><article><h1>Title</h1><p>{BODY}</p><p>Sho<b>rt</b>&amp;sweet&nbsp; x</p></article><footer>No</footer>"),
     f"Title {BODY}Short&sweet x"),
    (page(f"<div id=sidebar><p>{BODY * 3}</p></div><div class='post-content'><h2>T</h2><p>{BODY}<p>{BODY}<ul><li>one<li>two</ul></div>"
          f"<div class='comments'><p>{BODY * 5}</p></div>"), f"T {BODY}{BODY}one two"),
    (page(f"<main><form><p>{BODY}</p><input></form><p>{BODY}</p><aside>no</aside><div class=ad>buy, buy, buy</div></main>"), BODY.strip()),
    (page(f"<div><div role=navigation>{BODY}</div><p>{BODY}</p><p>{BODY}</p><div hidden>{BODY}</div></div>"), (BODY * 2).strip()),
    (page(f"<article><p>{BODY}<!-- <p>not, this</p> --><script>if (a<b) '</p>'</script></p><table><tr><td>a<td>b</table></article>"), f"{BODY}a b"),
    (page(f"<article><p><b>{BODY}<br><p>{BODY}</article>"), (BODY * 2).strip()),
    (page("<article>" + "<div>" * 3000 + BODY + "</article>"), BODY.strip()),
])
def test_main_text(html, want):
    assert extraction.main_text(html) == want


def test_pages_whole_table(spark, sf):
    rows = queries.op3_html_extraction(spark, sf).collect()
    source = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    assert len(rows) == len(source)
    import html as h
    import re
    for r in rows:  # these pages keep their text in one article element
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)
        want = re.sub(r"</?(?:h1|p|br)[^>]*>", " ", inner[1])
        want = " ".join(h.unescape(re.sub(r"</?b>", "", want)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_pages_awkward_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<p"), (2, "u", "<p"), (3, "u", "<" * 500 + "a='")]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.count() == 5 and got.where("text is null").count() == 0
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def nearest(rows, every, k=10):
    fine = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)]
    out = {}
    for i, v in fine:
        if i % every == 0:
            score = sorted((float(np.sqrt(((np.asarray(w) - v) ** 2).sum())), j) for j, w in fine if j != i and len(w) == len(v))
            out[i] = score[:k]
    return out


def test_vectors_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want, every = nearest(rows, 100), nearest(rows, 100, k=len(rows))
    got = {}
    for r in queries.op4_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    same = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert same >= 0.99 * sum(map(len, want.values()))
    for i in want:
        exact = {j: s for s, j in every[i]}
        assert [s for s, _ in got[i]] == pytest.approx([exact[j] for _, j in got[i]], abs=1e-12)
        assert got[i] == sorted(got[i])


def test_vectors_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (100, [0.5, 0.5]), (9, [3.0, 4.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.nearest_vectors(df).orderBy("query_id", "rank").collect()
    want = nearest(rows, 100)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(i, j) for i in sorted(want) for _, j in want[i]]
    assert vectors.nearest_vectors(df.where("1 = 0")).count() == 0


def test_vectors_in_blocks(spark, sf):
    df = table(spark, sf, "embeddings")
    one = vectors.nearest_vectors(df, every=10).collect()
    many = vectors.nearest_vectors(df, every=10, block=13, queries=7).collect()
    key = lambda r: (r["query_id"], r["rank"])
    assert [(key(r), r["vec_id"]) for r in sorted(one, key=key)] == [(key(r), r["vec_id"]) for r in sorted(many, key=key)]


def test_language_of_held_out_documents(spark, sf):
    rows = table(spark, sf, "documents")
    model = language.train(rows.where("doc_id % 2 = 0"))
    blind = rows.where("doc_id % 2 = 1").withColumn("declared_lang", rows["lang"]).withColumn("lang", language.F.lit(None).cast("string"))
    got = language.identify_documents(blind, model)
    truth = {r["doc_id"]: r["declared_lang"] for r in blind.collect()}
    found = got.collect()
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in found]) >= 0.97


def test_pages_language(spark, sf):
    got = queries.op7_language_id(spark, sf).collect()
    assert len(got) == table(spark, sf, "pages").count()
    assert np.mean([r["language"] == r["declared"] for r in got]) > 0.9 and np.mean([r["accepted"] for r in got]) > 0.95


def test_evidence_is_fused(spark, sf):
    model = language.train(table(spark, sf, "documents"))
    # a text that says little: the host's other pages and the declared language decide
    many = [(i, " ".join(["ist und der die"] * 5), "de", "h1") for i in range(30)] + [(i, "the and was of it", "en", "h2") for i in range(30, 60)]
    short = [(100, "7", None, "h1"), (101, "7", None, "h2"), (102, "7", "de", None)]
    got = {r["doc_id"]: r for r in language.identify_documents(docs(spark, many + short), model).collect()}
    assert got[100]["language"] == "de" and got[101]["language"] == "en" and got[102]["language"] == "de"


def test_language_rejects_only_what_says_nothing(spark, sf):
    rows = table(spark, sf, "documents")
    kept = language.keep_identified(rows)
    assert kept.count() >= 0.99 * rows.count() and kept.columns == rows.columns
    odd = rows.unionByName(docs(spark, [(-1, None), (-2, ""), (-3, "12 34 !! ??"), (-4, None, None, None)]))
    assert language.keep_identified(odd).where("doc_id < 0").count() == 0


def test_language_awkward_rows(spark):
    assert language.identify_documents(awkward(spark)).count() == 11
    empty = docs(spark, [])
    assert language.keep_identified(empty).count() == 0 and language.identify_documents(empty).count() == 0
    no_pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify_pages(no_pages, empty).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "not an address", "<p>"), (2, "not an address", "<p>")], "page_id long, url string, html string")
    some = docs(spark, [(i, f"the words of text {i}", "en") for i in range(20)])
    assert language.identify_pages(odd, some).count() == 3


def classes_by_force(texts):
    """Least doc_id of the connected class, over all pairs."""
    norm = {i: " ".join((t or "").lower().split()) for i, t in texts.items()}
    grams = {i: near.kmers(t) for i, t in norm.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(texts) if norm[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if root(a) != root(b) and (norm[a] == norm[b] or near.similar(grams[a], grams[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in texts}


def test_near_duplicates_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op9_near_duplicates(spark, sf).collect()}
    assert got == classes_by_force(texts)


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, n = {}, 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(12):
        text = [word() for _ in range(rng.choice([12, 60, 200, 400]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(text)
            for _ in range(max(0, int(len(text) * rng.choice([0, 0.005, 0.02])))):
                copy[rng.randrange(len(copy))] = word()
            texts[n] = " ".join(copy)
            n += 1
    for _ in range(40):  # a shared passage alone does not make near-duplicates
        texts[n] = passage + " " + " ".join(word() for _ in range(60))
        n += 1
    chain = [word() for _ in range(200)]
    for k in range(12):  # neighbours are alike, the ends are not
        chain[k * 15] = word()
        texts[n] = " ".join(chain)
        n += 1
    return texts


def test_near_duplicates_planted(spark, monkeypatch):
    texts = planted()
    texts |= {900: None, 901: "", 902: "  ", 903: "Two words", 904: "two  WORDS", 905: "x"}
    want = classes_by_force(texts)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert got == want and got[903] == got[904] == 903 and got[900] == 900 and got[902] == 902
    monkeypatch.setattr(near, "ROUNDS", 1)
    monkeypatch.setattr(near, "BLOCK", 5)
    again = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert again == want


def test_near_duplicates_without_spaces(spark):
    """Copies of a text that does not separate words, with a character changed or a passage moved along, are one class."""
    rng = random.Random(2)
    letters = [chr(0x4e00 + i) for i in range(3000)]
    text = "".join(rng.choice(letters) for _ in range(2000))
    other = "".join(rng.choice(letters) for _ in range(2000))
    rows = [(1, text), (2, text[:900] + "x" + text[901:]), (3, "".join(rng.choice(letters) for _ in range(7)) + text), (4, other), (5, other[:-30])]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, a) == 100 and near.aligned(a, a[::-1]) <= 20
    assert near.similar(a, a[10:]) and not near.similar(a, a[25:])
    swapped = np.concatenate([a[50:], a[:50]])  # the same set in another order
    assert not near.similar(a, swapped)


def test_repeated_kmers_are_told_apart():
    x = near.kmers("a b c d e " * 6 + "z")
    assert len(set(x.tolist())) == len(x)
    assert len(near.kmers("a b")) == 1 and len(near.kmers("")) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(200)] + [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(40)]
    got = {r["vertex"]: r["label"] for r in near.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_in_two_parts(spark):
    """Links that come after contraction began join classes by any of their vertices."""
    frame = lambda edges: spark.createDataFrame(edges, "a string, b string")
    rng = random.Random(3)
    first = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i % 20 != 19]
    second = [(f"{rng.randrange(80):03d}", f"{rng.randrange(80):03d}") for _ in range(12)] + [("019", "020")]
    edges, labels = near._contracted(frame(first), None)
    lifted = near._lifted(frame(second), labels)
    got = {r["vertex"]: r["label"] for r in near.components(edges.union(lifted), labels).collect()}
    want = {r["vertex"]: r["label"] for r in near.components(frame(first + second)).collect()}
    assert got == want
    assert near.components(frame([])).count() == 0


def test_near_duplicates_awkward_rows(spark):
    wide = awkward(spark)
    got = near.near_duplicates(wide)
    assert got.count() == 11
    same = {r["class_id"] for r in got.where("doc_id = 5").collect()}
    assert same == {4}
    kept = near.keep_first(wide)
    assert kept.columns == wide.columns
    assert Counter(r["text"] for r in kept.collect())["same text"] == 1
    assert kept.where("text = 'no id here'").count() == 1
    assert near.near_duplicates(docs(spark, [])).count() == 0 and near.keep_first(docs(spark, [])).count() == 0


def test_stages(spark, sf):
    rows = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mix_sources", "pack"]
    steps = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        assert steps[name](spark, rows, sf).columns == rows.columns
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = classes_by_force(texts)
    kept = [r["doc_id"] for r in steps["near_dedup"](spark, rows, sf).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    masked = {r["doc_id"]: r for r in steps["secret_scan"](spark, rows, sf).collect()}
    assert set(masked) == set(texts)
    import re
    assert not any(re.search(r"[0-9a-f]{16}", r["text"]) for r in masked.values())
    mixed = Counter(r["doc_id"] for r in steps["mix_sources"](spark, rows, sf).select("doc_id").collect())
    assert max(mixed.values()) <= 3


def test_stages_with_awkward_rows(spark, sf):
    for rows in (awkward(spark), docs(spark, [])):
        for _, step in corpus_pipeline.STAGES:
            step(spark, rows, sf).collect()


def test_masking_keeps_other_columns(spark):
    """Columns with the names of the scan's own come through as they were."""
    rows = docs(spark, [(1, "password = abcdefgh12345678"), (2, None), (3, "nothing to hide"), (3, "nothing to hide")])
    for name in ("spans", "_assign", "_fixed", "_random", "row", "changed"):
        rows = rows.withColumn(name, rows["source"])
    out = corpus_pipeline.mask_secrets(spark, rows, "")
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert "abcdefgh" not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None
    assert all(r[name] == "s" for r in got.values() for name in ("spans", "_assign", "_fixed", "_random", "row", "changed"))
    assert out.count() == 4 and corpus_pipeline.mask_secrets(spark, rows.limit(0), "").count() == 0


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    by_sequence = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
