"""Binary token files: concatenated ids with Elias-Fano coded document boundaries.

A file holds one range of documents in ascending order:

    ids        all ids of all documents, 2 bytes each where the vocabulary allows it, else 4
    names      doc_id of every document, 8 bytes each; then a byte each, 1 for a missing doc_id
    low        the low bits of every boundary, packed
    high       the high bits in unary: boundary i sets bit (boundary >> width) + i
    samples    the place in ``high`` of every 256th set bit, 4 bytes each
    footer     the number of documents and ids, widths and section sizes

Boundary i is where document i ends. It takes about 2 + log2(ids / documents) bits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.tokens import ID, encoder, vocabulary
from txnrisk.session import shared_folder, stage

MAGIC = b"TXNTOK01"
_FOOTER = struct.Struct("<QQBBQQQ8s")
SAMPLE = 256
#: Bytes of text that go to one file, and most files: beyond that, files hold more text.
FILE_BYTES = 16 << 20
MOST_FILES = 20_000
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_boundaries(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(width, low, high, samples) of ascending boundaries; the last is the universe."""
    n = len(ends)
    if not n:
        return 0, b"", b"", b""
    ends = ends.astype(np.uint64)
    width = max(0, int(int(ends[-1]) // n).bit_length() - 1)
    low = np.empty(0, np.uint8)
    if width:
        bits = (ends[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
    ones = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    return width, low.tobytes(), packed, ones[::SAMPLE].astype("<u4").tobytes()


class Boundaries:
    """Answers where documents end from the packed form alone."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    def _low(self, i: int) -> int:
        at, out = i * self.width, 0
        for k in range(self.width):
            bit = at + k
            out |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Where document i ends, from the nearest sample before it."""
        place = int(self.samples[i // SAMPLE])
        byte, want = place >> 3, i % SAMPLE
        want += int(_POPULATION[int(self.high[byte]) & ((1 << (place & 7)) - 1)])
        while True:
            seen = np.cumsum(_POPULATION[self.high[byte:byte + 64]])
            if seen[-1] > want:
                break
            want -= int(seen[-1])
            byte += 64
        k = int(np.searchsorted(seen, want, "right"))
        want -= int(seen[k - 1]) if k else 0
        bits = np.flatnonzero(np.unpackbits(self.high[byte + k:byte + k + 1], bitorder="little"))
        place = (byte + k) * 8 + int(bits[want])
        return (place - i) << self.width | self._low(i)

    def start(self, i: int) -> int:
        return self.select(i - 1) if i else 0

    def between(self, first: int, stop: int) -> np.ndarray:
        """Where the documents from ``first`` to before ``stop`` end: select for neighbours, from the
        sample before the first to the one after the last. No other part is decoded."""
        if first >= stop:
            return np.empty(0, np.int64)
        sample, after = first // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[sample])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        byte = begin >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte:(end + 7) >> 3], bitorder="little")) + 8 * byte
        skip = int(np.searchsorted(ones, begin)) + first - sample * SAMPLE
        ends = (ones[skip:skip + stop - first] - np.arange(first, stop)) << self.width
        if self.width:
            bit = first * self.width
            bits = np.unpackbits(self.low[bit >> 3:(stop * self.width + 7) >> 3], bitorder="little")[bit & 7:]
            rows = bits[:(stop - first) * self.width].reshape(stop - first, self.width)
            ends = ends + rows.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return ends

    def all(self) -> np.ndarray:
        """Every boundary in order."""
        return self.between(0, self.n)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFile:
    """One file: any document by its number, or all in order, without reading the whole file."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        tail = self.source.read_at(_FOOTER.size, size - _FOOTER.size)
        n, self.ids, self.wide, width, low, high, samples, magic = _FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        at = self.ids * self.wide
        names = self.source.read_at(9 * n, at)
        missing = np.frombuffer(names, np.uint8, offset=8 * n)
        self.names = [None if m else int(x) for x, m in zip(np.frombuffer(names, "<i8", n), missing)]
        rest = self.source.read_at(low + high + samples, at + 9 * n)
        self.ends = Boundaries(n, width, rest[:low], rest[low:low + high], rest[low + high:])

    def document(self, i: int) -> np.ndarray:
        start, end = self.ends.start(i), self.ends.select(i)
        return self._read(start, end)

    def _read(self, start: int, end: int) -> np.ndarray:
        raw = self.source.read_at((end - start) * self.wide, start * self.wide)
        return np.frombuffer(raw, f"<u{self.wide}").astype(ID)

    def documents(self, at_once: int = 4 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of every document. Boundaries are selected for SAMPLE documents at a time."""
        start = 0
        for first in range(0, self.ends.n, SAMPLE):
            ends = self.ends.between(first, min(first + SAMPLE, self.ends.n)).tolist()
            i = 0
            while i < len(ends):
                k = i + 1
                while k < len(ends) and ends[k] - start <= at_once:
                    k += 1
                block, base = self._read(start, ends[k - 1]), start
                for j in range(i, k):
                    yield self.names[first + j], start, block[start - base:ends[j] - base]
                    start = ends[j]
                i = k

    def close(self) -> None:
        self.source.close()


def _write(folder: str, path: str, end_id: int, wide: int, part: int,
           batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encode, end = encoder(path).encode, np.asarray([end_id], ID).tobytes()
    uri = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
    out, ends, names, missing, total = None, [], [], [], 0
    for batch in batches:
        for doc, raw in zip(batch["doc_id"], encode(batch["text"])):
            if out is None:
                system, place = _opened(uri)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            ids = np.frombuffer(raw + end, ID).astype(f"<u{wide}")
            out.write(ids.tobytes())
            total += len(ids)
            ends.append(total)
            names.append(0 if doc is None else int(doc))
            missing.append(doc is None)
    if out is None:
        return
    width, low, high, samples = pack_boundaries(np.asarray(ends, np.int64))
    for section in (np.asarray(names, "<i8").tobytes(), np.asarray(missing, np.uint8).tobytes(), low, high, samples):
        out.write(section)
    out.write(_FOOTER.pack(len(ends), total, wide, width, len(low), len(high), len(samples), MAGIC))
    out.close()
    yield pd.DataFrame({"part": [part], "documents": [len(ends)], "ids": [total], "file": [uri]})


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2, path: str | None = None,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; missing ids come first.

    Gives the manifest, one row per file in order: part, documents, ids, file. ``folder`` must be
    reachable by all executors; by default a new one below spark.checkpoint.dir. A file is
    named anew on every attempt and counts only if the manifest, stored once all tasks are
    done, names it, so retried or doubled tasks do no harm. Rows of one doc_id are ordered by
    text. A null text has the end id only; no rows give an empty manifest.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder, path = folder or shared_folder(spark, "tokens"), vocabulary(path)
    wide = 2 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    files = max(1, min(-(-size // file_bytes), MOST_FILES))
    ordered = (plain.repartitionByRange(files, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
               .select(F.col("doc_id").cast("string").alias("doc_id"), "text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _write(folder, path, end_id, wide, TaskContext.get().partitionId(), batches)

    return stage(ordered.mapInPandas(write, "part int, documents long, ids long, file string"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of every document.

    The driver sees the manifest, one short row for each of at most ``MOST_FILES`` files, to number the files' ids.
    """
    spark = manifest.sparkSession
    before, listed = 0, []
    for r in manifest.select("part", "ids", "file").orderBy("part").collect():
        listed.append((r["file"], before))
        before += r["ids"]
    files = spark.createDataFrame(listed, "file string, before long").repartition(max(1, len(listed)), "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, base in zip(batch["file"], batch["before"]):
                opened, rows, held = TokenFile(file), [], 0
                for doc, start, ids in opened.documents():
                    rows.append((None if doc is None else str(doc), base + start, len(ids), ids.tobytes()))
                    held += len(ids)
                    if held > 2_000_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
                        rows, held = [], 0
                opened.close()
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])

    return (files.mapInPandas(read, "doc_id string, start long, n_tokens long, ids binary")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
