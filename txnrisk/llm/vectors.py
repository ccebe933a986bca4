"""Nearest vectors by randomly rotated one-bit codes, estimates with error bounds, and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.session import stage

NEAREST = 10
SEED = 20
#: Width of the error bound in deviations of the estimate; 1.9 is the published choice for 95 %.
DEVIATIONS = 4.0
#: Rows of a block of vectors and of a block of queries that are compared in one task.
BLOCK, QUERIES, BLOCKS = 65_536, 4_096, 16
_AT_ONCE = 64


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(table: DataFrame) -> DataFrame:
    """vec_id, embedding (double), size of the rows that take part.

    Left out: missing or empty vectors, vectors with missing or non-finite components, all
    zeros, and rows without a vec_id, which no result could name.
    """
    wide = table.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (wide.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(fine & F.exists("embedding", lambda x: x != 0))
            .withColumn("size", F.size("embedding")))


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each size: sums per task, added up; a row per size and component."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, group in batch.groupby("size"):
                x = np.stack(group["embedding"].to_numpy())
                held[size] = held.get(size, 0) + np.append(x.sum(0), len(x))
        for size, total in held.items():
            yield pd.DataFrame({"size": size, "at": range(size + 1), "total": total})

    found: dict[int, dict[int, float]] = {}
    rows = vectors.mapInPandas(sums, "size int, at int, total double").groupBy("size", "at").agg(F.sum("total").alias("total"))
    for r in rows.collect():
        found.setdefault(r["size"], {})[r["at"]] = r["total"]
    return {n: np.array([x[i] for i in range(n)]) / x[n] for n, x in found.items()}


def encode(vectors: DataFrame, middle: dict[int, np.ndarray], seed: int = SEED) -> DataFrame:
    """Add code (packed signs of the rotated vector about the centre), norm and match.

    ``match`` is the inner product of the unit vector with its code's corner of the cube, which
    corrects every estimate made from the code.
    """
    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby("size"):
                turned = (np.stack(group["embedding"].to_numpy()) - middle[size]) @ rotation(size, seed)
                norm = np.linalg.norm(turned, axis=1)
                match = np.abs(turned).sum(1) / np.sqrt(size) / np.where(norm > 0, norm, 1)
                yield group.assign(code=[x.tobytes() for x in np.packbits(turned > 0, axis=1)],
                                   norm=norm, match=np.where(norm > 0, match, 1.0))

    return vectors.mapInPandas(coded, "vec_id long, embedding array<double>, size int, code binary, norm double, match double")


def _search(codes: np.ndarray, norm: np.ndarray, match: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
            queries: np.ndarray, query_ids: np.ndarray, middle: np.ndarray, nearest: int, seed: int,
            deviations: float) -> list[tuple[int, int, float]]:
    """The nearest of one block for each query of one block."""
    size = vectors.shape[1]
    corners = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    spread = np.sqrt(np.maximum(1 / match ** 2 - 1, 0) / max(size - 1, 1)) * deviations
    out = []
    for at in range(0, len(queries), _AT_ONCE):
        turned = (queries[at:at + _AT_ONCE] - middle) @ rotation(size, seed)
        length = np.linalg.norm(turned, axis=1)
        unit = turned / np.where(length > 0, length, 1)[:, None]
        cosine = (unit.astype(np.float32) @ corners.T).astype(np.float64) / match
        for k in range(len(turned)):
            both = 2 * length[k] * norm
            base = norm ** 2 + length[k] ** 2 - both * np.clip(cosine[k], -1, 1)
            slack = both * spread + 1e-5 * (norm ** 2 + length[k] ** 2)
            own = ids == query_ids[at + k]
            upper = np.where(own, np.inf, base + slack)
            limit = np.partition(upper, nearest - 1)[nearest - 1] if len(upper) > nearest else np.inf
            chosen = np.flatnonzero((base - slack <= limit) & ~own)
            exact = np.sqrt(((vectors[chosen] - queries[at + k]) ** 2).sum(1))
            order = np.lexsort((ids[chosen], exact))[:nearest]
            out += [(int(query_ids[at + k]), int(ids[chosen[i]]), float(exact[i])) for i in order]
    return out


def nearest_vectors(table: DataFrame, every: int = 100, nearest: int = NEAREST, seed: int = SEED,
                    deviations: float = DEVIATIONS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of every row whose vec_id ``every`` divides.

    score is the Euclidean distance of the original vectors in double precision. A query is
    compared with vectors of its own length only, and never with rows of its own vec_id. Ties
    go to the smaller vec_id. Rows that repeat a vec_id are candidates each; as queries they
    count once (the least vector). No usable rows give no result.

    A block of vectors meets a block of queries in one task, so no task holds more than one of
    each. There the codes give every distance with a bound on its error; vectors whose lower
    bound is above the k-th smallest upper bound are passed over, the others are measured.
    """
    found = usable(table)
    middle = centres(found)
    spark = table.sparkSession
    if not middle:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = stage(encode(found, middle, seed), "vector-index")
    total = index.count()
    blocks = max(BLOCKS, -(-total // block))
    asked = (index.where(F.col("vec_id") % every == 0).groupBy("vec_id", "size")
             .agg(F.min("embedding").alias("embedding")))
    groups = max(1, -(-asked.count() // queries))
    pairs = "size int, vb int, qb int"
    cut = index.withColumn("vb", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))
    cut = cut.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ask = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    ask = ask.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            size = int(left["size"].iloc[0])
            codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            rows = _search(codes, left["norm"].to_numpy(), left["match"].to_numpy(), np.stack(left["embedding"].to_numpy()),
                           left["vec_id"].to_numpy(), np.stack(right["embedding"].to_numpy()),
                           right["vec_id"].to_numpy(), middle[size], nearest, seed, deviations)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = [p.split()[0] for p in pairs.split(", ")]
    best = (cut.groupBy(*keys).cogroup(ask.groupBy(*keys))
            .applyInPandas(compare, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
