"""Best-fit packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.llm.tokens import ID, encoder, vocabulary

CAPACITY = 2048
#: Parts that items of one length are ranked in, so that no length is ranked in one task.
SALTS = 256
#: Items of one length and part; more rows give more parts.
ITEMS = 100_000
#: Bytes of ids that a worker hands over at a time; frame, Arrow batch and stream each hold them once more.
HELD = 1_000_000
#: Rows of an Arrow batch that become Python strings at a time.
ROWS = 256


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut what is longer than ``capacity``.

    Gives doc_id, piece (from 0), start (ids of the document before it), length and ids
    (binary, little-endian unsigned 32-bit). Every document ends with ``end_id``, so a null
    or empty text has one piece of one id. Repeated rows are packed once each. Other columns
    of ``docs`` are not read.
    """
    path = vocabulary(path)
    end = np.asarray([end_id], ID).tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        kinds = pa.schema([("doc_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows = zip(_values(batch.column("doc_id")), encode(_values(batch.column("text"))))
            for frame in _frames((doc, k, at // 4, min(step, len(raw) - at) // 4, raw[at:at + step])
                                 for doc, ids in rows for raw in (ids + end,)
                                 for k, at in enumerate(range(0, len(raw), step))):
                yield pa.RecordBatch.from_pandas(frame, kinds, preserve_index=False)
            pa.default_memory_pool().release_unused()

    # ids travel as text: they may be of any type
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(cut, "doc_id string, piece int, start long, length long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _values(column: pa.Array, at_once: int = ROWS) -> Iterator[str | None]:
    """The column's values; few of them are Python objects at a time, where a batch may be 10,000 long texts."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def _frames(rows: Iterable[tuple], most: int = HELD) -> Iterator[pd.DataFrame]:
    """Frames of pieces in order, each of little more than ``most`` bytes of ids."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1])
        if held > most:
            yield _frame(some)
            some, held = [], 0
    if some:
        yield _frame(some)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the items of each length go, from the number of items of each length alone.

    Rows (length, first rank, first sequence, items per sequence, offset): items of that
    length from that rank on fill sequences in turn. Items above a third of the capacity are
    matched first, longest first, each with the longest partner that still fits, so at most
    two share a sequence; shorter ones then go, longest first, to the smallest gap that holds
    them. The table depends on the lengths there are, not on how many items have them.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, first: int, sequences: int, per: int, gap: int) -> None:
        out.append((length, used[length], first, per, capacity - gap))
        used[length] += sequences * per
        left[length] -= sequences * per

    third = capacity // 3
    for length in sorted((n for n in left if n > third), reverse=True):
        while left[length]:
            partner = next((m for m in range(min(length, capacity - length), third, -1)
                            if left.get(m, 0) > (m == length)), None)
            if partner is None:
                number, rest = left[length], capacity - length
                put(length, opened, number, 1, capacity)
            else:
                number = left[length] // 2 if partner == length else min(left[length], left[partner])
                rest = capacity - length - partner
                put(length, opened, number, 1, capacity)
                put(partner, opened, number, 1, capacity - length)
            if rest:
                gaps[rest].append((opened, number))
            opened += number
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), 0)
            per = min((gap or capacity) // length, left[length])
            if gap:
                first, free = gaps[gap].pop()
                number = min(free, left[length] // per)
                if free > number:
                    gaps[gap].append((first + number, free - number))
            else:
                gap, first, number = capacity, opened, left[length] // per
                opened += number
            put(length, first, number, per, gap)
            if gap > per * length:
                gaps[gap - per * length].append((first, number))
    return np.asarray(sorted(out), np.int64).reshape(-1, 5)


def place(items: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``items``, which have a ``length`` from 1 to ``capacity``.

    ``keys`` name the items; rows that agree in them and in length are interchangeable.
    Items of a length are numbered without gaps: inside a part given by a hash, plus the
    items of the parts before it. Only the number of items of each length, at most
    ``capacity`` rows, reaches the driver, where ``plan`` turns it into placements. ``items``
    is read three times: store it first if it is costly.
    """
    spark = items.sparkSession
    counted = items.groupBy("length").count().collect()
    total = sum(r["count"] for r in counted)
    if not total:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = plan({r["length"]: r["count"] for r in counted}, capacity)
    salts = max(SALTS, total // ITEMS)
    salted = items.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = (salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(
                  Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*keys)) - 1
    ranked = (salted.withColumn("_inside", inside).join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"))
    lines = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def found(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = lines.value
        keyed = table[:, 0] * (1 << 50) + table[:, 1]
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        line = table[np.searchsorted(keyed, n * (1 << 50) + r, "right") - 1]
        past = r - line[:, 1]
        return pd.DataFrame({"sequence_id": line[:, 2] + past // line[:, 3],
                             "offset": line[:, 4] + past % line[:, 3] * n})

    return (ranked.withColumn("_at", found("length", "_rank"))
            .select(*items.columns, "_at.sequence_id", "_at.offset"))
