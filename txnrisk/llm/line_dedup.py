"""Line de-duplication: two Bloom filters point out suspected repeats, only those meet for an exact answer.

1. Every document's line keys are hashed. Bare 64-bit hashes, no lines, go to segments of the
   hash space; each segment has a filter of the hashes seen once and one of those seen twice.
2. The twice-seen filters are folded to a bounded size and broadcast. A document none of whose
   keys is in them is done; it is neither shuffled nor looked at again.
3. The suspected keys alone are grouped by their full bytes, which decides what repeats and where
   it stays. Documents with suspected keys meet their lists of dropped lines.

A filter has no false negatives, so the result does not depend on its size: a crowded filter
sends more lines to step 3, in the extreme all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.session import stage

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Hashes that one segment's two filters are sized for, and their bits (16 a hash).
SEGMENT_KEYS = 1 << 20
SEGMENT_BITS = 1 << 24
PROBES = 5
#: Most bytes of the filter that is broadcast; beyond it, the filter is folded and gets crowded.
FILTER_BYTES = 64 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LINES = "struct<row: binary, n_lines: int, lines: array<struct<key: binary, at: array<int>>>>"
_LINES_ARROW = pa.struct([("row", pa.binary()), ("n_lines", pa.int32()), ("lines", pa.list_(
    pa.struct([("key", pa.binary()), ("at", pa.list_(pa.int32()))])))])


def line_keys(text: bytes, least: int = LEAST_CHARS) -> dict[bytes, list[int]]:
    """Each key of ``text`` with at least ``least`` code points, and the numbers of its lines.

    Of bytes, strip() and lower() touch exactly the white space and the letters of ASCII.
    """
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least):
            found.setdefault(key, []).append(at)
    return found


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a filter of ``bits`` (a power of two) that belong to each hash, a row each."""
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes * _SPREAD >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(PROBES, dtype=np.uint64)
    return ((first[:, None] + turns * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class TwoFilters:
    """One segment's filters of hashes seen once and hashes seen twice."""

    def __init__(self, bits: int = SEGMENT_BITS):
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        at = places(values, len(self.once))
        again = self.once[at].all(axis=1) | (counts > 1)
        self.once[at] = True
        self.twice[at[again]] = True


def folded(filter_bits: np.ndarray, bits: int) -> np.ndarray:
    """The same filter in ``bits`` places: whatever the larger one finds, this one finds."""
    return filter_bits.reshape(-1, bits).any(axis=0)


def _segment_bits(segments: int) -> int:
    return segments.bit_length() - 1


def _hashed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the keys of each document; of a batch, at most two of a kind, which is all the filters need."""
    for batch in batches:
        found = [xxhash.xxh64_intdigest(key) for text in batch.column(0).to_pylist() for key in line_keys(text, least)]
        values, counts = np.unique(np.asarray(found, np.uint64), return_counts=True)
        out = np.concatenate([values, values[counts > 1]])
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["hash"])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, ones, bits) of each segment's twice-seen filter; rows come ordered by segment."""
    now, filters = None, None

    def done() -> pa.RecordBatch:
        bits = np.packbits(filters.twice, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int64()), "ones": pa.array([int(filters.twice.sum())], pa.int64()),
                                           "bits": pa.array([bits], pa.binary())})

    for batch in batches:
        segments, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for cut in np.split(np.arange(len(segments)), np.flatnonzero(np.diff(segments)) + 1):
            if not len(cut):
                continue
            if now != segments[cut[0]]:
                if filters is not None:
                    yield done()
                now, filters = int(segments[cut[0]]), TwoFilters()
            filters.add(hashes[cut])
    if filters is not None:
        yield done()


class Suspects:
    """The folded twice-seen filters of all segments, to ask whether a hash may repeat."""

    def __init__(self, segments: int, bits: int, packed: np.ndarray):
        self.segments, self.bits, self.packed = segments, bits, packed

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        shift = _segment_bits(self.segments)
        base = (hashes >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(hashes), np.int64)
        at = places(hashes, self.bits) + base[:, None] * self.bits
        return ((self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def seen_twice(texts: DataFrame, least: int = LEAST_CHARS, filter_bytes: int = FILTER_BYTES) -> Suspects:
    """The twice-seen filters of the line keys of ``texts`` (one binary column).

    Only the filters reach the driver, folded until at most a quarter of the bits is set on
    average, further where they would take more than ``filter_bytes``.
    """
    found = stage(texts.mapInArrow(lambda batches: _hashed(batches, least), "hash long"), "line-hashes")
    segments = 1 << max(0, -(-found.count() // SEGMENT_KEYS) - 1).bit_length()
    shift = _segment_bits(segments)
    segment = F.shiftrightunsigned("hash", 64 - shift) if shift else F.lit(0).cast("long")
    filters = stage(found.select(segment.alias("segment"), "hash").repartition(segments, "segment")
                    .sortWithinPartitions("segment").mapInArrow(_built, "segment long, ones long, bits binary"), "line-filters")
    ones = filters.agg(F.sum("ones")).head()[0] or 0
    bits = min(SEGMENT_BITS, 1 << max(10, (4 * ones // segments).bit_length()))
    while bits > 8 and segments * bits // 8 > filter_bytes:
        bits //= 2

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").astype(bool) for b in batch.column(1).to_pylist()]
            small = [np.packbits(folded(w, bits), bitorder="little").tobytes() for w in wide]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], ["segment", "bits"])

    packed = np.zeros((segments, bits // 8), np.uint8)
    for r in filters.select("segment", "bits").mapInArrow(fold, "segment long, bits binary").toLocalIterator():
        packed[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Suspects(segments, bits, packed.ravel())


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                        filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, anything else) without the lines that repeat across documents.

    A line's key is the line without white space (ASCII) at its ends and with A-Z in lower case. A key of
    at least ``least_chars`` code points found in at least ``least_docs`` documents keeps its
    lines, all of them, in the document of largest doc_id alone. The other lines stay, joined
    by newlines, in ``text``; n_lines (before) and n_dropped are added, with a trailing
    underscore where ``docs`` has such a column. Other columns are passed on untouched.

    A null text counts as empty and becomes so: one empty line. Rows of one doc_id are one document
    when documents are counted, and every row of the document that keeps a key keeps its lines;
    rows without doc_id are together one document, smaller than all others. Repeated rows get
    equal results. An empty table gives an empty one.
    """
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    spark = docs.sparkSession
    suspects = spark.sparkContext.broadcast(seen_twice(base.select("text"), least_chars, filter_bytes))

    def mark(text: pa.Array, doc: pa.Array) -> pa.Array:
        out, ask, where = [], [], []
        for raw, name in zip(text.to_pylist(), doc.to_pylist()):
            found = line_keys(raw, least_chars)
            for key in found:
                ask.append(xxhash.xxh64_intdigest(key))
                where.append((len(out), key, found[key]))
            row = xxhash.xxh3_128_digest(b"%d:" % name + raw if name is not None else b":" + raw)
            out.append({"row": row, "n_lines": raw.count(b"\n") + 1, "lines": []})
        for i in np.flatnonzero(suspects.value(np.asarray(ask, np.uint64))):
            k, key, at = where[i]
            out[k]["lines"].append({"key": key, "at": at})
        return pa.array(out, _LINES_ARROW)

    def without(text: pa.Array, drop: pa.Array) -> pa.Array:
        out = []
        for raw, gone in zip(text.to_pylist(), drop.to_pylist()):
            if gone:
                gone = set(gone)
                raw = b"\n".join([line for i, line in enumerate(raw.split(b"\n")) if i not in gone])
            out.append(raw)
        return pa.array(out, pa.binary())

    # marked as not deterministic so that Spark does not work them out again for every use of their result
    marked = base.withColumn("mark", F.arrow_udf(mark, _LINES).asNondeterministic()("text", "doc_id"))
    unmarked = marked.where(F.size("mark.lines") == 0)
    lines = stage(marked.select("doc_id", "mark.row", F.explode("mark.lines").alias("line"))
                  .select("doc_id", "row", "line.key", "line.at"), "suspected-lines")
    confirmed = (lines.select("key", "doc_id").distinct()  # first by key and document, so that no key's documents meet in one task
                 .groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least_docs))
    gone = (lines.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
            .groupBy("row").agg(F.flatten(F.collect_set("at")).alias("drop")))
    met = marked.where(F.size("mark.lines") > 0).withColumn("row", F.col("mark.row")).join(gone, "row", "left")
    rest = met.withColumn("text", F.arrow_udf(without, "binary").asNondeterministic()("text", "drop"))

    def shaped(rows: DataFrame, dropped: Column) -> DataFrame:
        kept = [F.col("text").cast("string").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names]
        lines_, gone_ = _free("n_lines", names), _free("n_dropped", names)
        return rows.select(*kept, F.col("mark.n_lines").cast("long").alias(lines_), dropped.cast("long").alias(gone_))

    return shaped(unmarked, F.lit(0)).unionByName(shaped(rest, F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))))
