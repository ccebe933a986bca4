import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from common import awkward, docs, table
from txnrisk.llm import packing, queries, token_files
from txnrisk.llm.tokens import Encoder, vocabulary

TOKENIZER = Tokenizer.from_file(vocabulary())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    odd = ["", None, "It's THE end\x1c!\x1c! x", "Σίσυφος ΑΣ", "a\xa0b c\x85d", "İstanbul ŉ ß ﬁ", "<|endoftext|> a<|startoftext|>b",
           "é ́x", "日本語 テキスト", "a'll'd''s ''re", "१२३ ½ 42nd", "x" * 5000, "­​ z", "µ ª º", "\x7f\x80 a"]
    made = Encoder(vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in made.encode(odd)]
    assert got == [plain(t) for t in odd]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]
    assert got == [plain(t) for t in texts]


ENCODER = Encoder(vocabulary(), remembered=50)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  there", None, "naïve\ttext "]
    other = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)]
    assert got == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, capacity=2048):
    """Every id of every document once, sequences filled without gaps or overlaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.asarray(plain(text) + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
            assert r["length"] == capacity or at == len(ids)
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_packing_whole_table(spark, sf):
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    used, least = check_packing(rows, texts)
    assert used <= least * 1.02 + 1


def simple_best_fit(lengths, capacity):
    """Best-fit decreasing, one item at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            if min(fits) > n:
                gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n) if n < capacity else None
            simple_best_fit.bins += 1
    return simple_best_fit.bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_every_item(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, 60)
    bins = {}
    for n, count in counts.items():
        own = [r for r in runs.tolist() if r[0] == n]
        for rank in range(count):
            _, first, sequence, per, offset = [r for r in own if r[1] <= rank][-1]
            past = rank - first
            bins.setdefault(sequence + past // per, []).append((offset + past % per * n, n))
    for places in bins.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 60 and sum(n > 20 for _, n in places) <= 2
    simple_best_fit.bins = 0
    assert len(bins) <= simple_best_fit(lengths, 60) * 1.1 + 1


def test_pieces_are_handed_over_in_frames_of_bounded_size():
    """A frame has one piece more than the bound at the most, a document of many pieces too; none is lost."""
    rows = [(str(i), k, k * 2048, 2048, bytes([i % 256]) * 8192) for i in range(10) for k in range(200)]
    frames = list(packing._frames(iter(rows)))
    assert max(int(f["ids"].map(len).sum()) for f in frames) <= 4_000_000 + 8192
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows
    assert not list(packing._frames([])) and len(frames) > 1


def test_a_batch_becomes_python_strings_little_by_little():
    """Of a batch of long texts a worker turns no more into Python objects than the encoder asks for; none is lost."""
    asked = []

    class Column:
        def __init__(self, held):
            self.held = held

        def __len__(self):
            return len(self.held)

        def slice(self, at, n):
            asked.append(n)
            return self.held.slice(at, n)

    texts = [None if i % 7 == 0 else f"text {i}" for i in range(1000)]
    values = packing._values(Column(pa.array(texts)))
    assert next(values) is None and asked == [packing.ROWS] and packing.ROWS < 1000
    assert [None, *values] == texts and not list(packing._values(pa.array([], pa.string())))


def test_packing_awkward_rows(spark):
    parts = packing.pieces(awkward(spark)).cache()
    assert parts.where("piece = 0").count() == 11
    placed = packing.place(parts, ["doc_id", "piece", "start", "ids"])
    assert placed.count() == parts.count()
    from collections import Counter
    spots = Counter((r["sequence_id"], r["offset"]) for r in placed.select("sequence_id", "offset").collect())
    assert max(spots.values()) == 1
    empty = docs(spark, [])
    none = packing.place(packing.pieces(empty), ["doc_id"])
    assert none.count() == 0 and "sequence_id" in none.columns


def test_token_files_round_trip(spark, sf):
    rows = sorted(queries.op10_token_files(spark, sf).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    at = 0
    for r, doc in zip(rows, sorted(texts), strict=True):
        ids = np.asarray(plain(texts[doc]) + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_in_several_files(spark, sf):
    source = table(spark, sf, "documents").select("doc_id", "text")
    manifest = token_files.write_token_files(source, file_bytes=20_000)
    files = manifest.orderBy("part").collect()
    assert len(files) > 3 and sum(f["documents"] for f in files) == source.count()
    opened = token_files.TokenFile(files[1]["file"])
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    for i, (doc, start, ids) in enumerate(opened.documents()):
        assert ids.tolist() == plain(texts[doc]) + [2] == opened.document(i).tolist()
        assert opened.ends.start(i) == start
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(texts)


def test_token_files_awkward_rows(spark):
    got = token_files.read_token_files(token_files.write_token_files(awkward(spark))).orderBy("start").collect()
    assert len(got) == 11 and [r["doc_id"] for r in got][:4] == [None, None, 1, 2]
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 100_000)), min_size=1, max_size=1500))
def test_boundaries(lengths):
    ends = np.cumsum(lengths)
    width, low, high, samples = token_files.pack_boundaries(ends)
    packed = token_files.Boundaries(len(ends), width, low, high, samples)
    assert packed.all().tolist() == ends.tolist()
    for i in {0, len(ends) // 3, len(ends) // 2, len(ends) - 1}:
        assert packed.select(i) == ends[i]
        for stop in {i, i + 1, min(i + 300, len(ends)), len(ends)}:
            assert packed.between(i, stop).tolist() == ends[i:stop].tolist()
    bits = 8 * (len(low) + len(high))
    assert bits <= len(ends) * (3 + max(0, np.log2(max(ends[-1] / len(ends), 1)))) + 16


def test_not_a_token_file(tmp_path):
    (tmp_path / "x.bin").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        token_files.TokenFile(f"file://{tmp_path}/x.bin")


def test_long_and_many_words_take_bounded_memory():
    made = Encoder(vocabulary(), remembered=3000)
    texts = [f"Word{i}, the {i} it's of{odd}all THINGS''S. {'x' * (i % 90)}é" for i in range(1500) for odd in ("\u00a0", "\x1c", " ", "'")] + ["y" * 30_000 + " z", " \n\t", None, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == [plain(t) for t in texts]
    assert made.words.older
    for memory in (made.words, made.pieces):
        assert all(len(w) <= 64 for w in [*memory.recent, *memory.older])
        assert max(sum(map(len, memory.recent)), sum(map(len, memory.older))) <= 3000 + 64


def test_most_files_are_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_FILES", 4)
    manifest = token_files.write_token_files(table(spark, sf, "documents").select("doc_id", "text"), file_bytes=1000)
    assert manifest.count() <= 4
    assert token_files.read_token_files(manifest).count() == table(spark, sf, "documents").count()
