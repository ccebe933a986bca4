"""Extendible hashing: shards that split on one more hash bit only where they are too large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from txnrisk.session import stage

LIMIT = 1 << 20
#: Bits looked at in one round; its directory has 2 ** BITS entries for each shard still too large.
BITS = 12
_HASH = 60


def _bits(hexadecimal) -> F.Column:
    return F.lpad(F.bin(F.conv(F.substring(hexadecimal, 1, _HASH // 4), 16, 10).cast("long")), _HASH, "0")


def assign_shards(docs: DataFrame, limit: int = LIMIT, keep: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """doc_id, bytes, shard, depth, shard_bytes for every row of ``docs`` (doc_id, text).

    ``shard`` is the leading bits of the row's hash, as many as ``depth`` says: the fewest with
    which all rows that share them fit into ``limit`` bytes. All rows fit: depth 0, shard "".
    A row larger than the limit ends in a shard of its own. The hash covers doc_id and text;
    repeated rows agree in it, so it goes on with 60 bits of the row's number in the stored
    table, by which they are split too. Missing ids and texts count as empty. ``keep`` names
    further columns to carry along. No rows give no shards.

    Bytes are summed per prefix before they are shuffled. A round looks only at rows of shards
    that the round before left too large.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = docs.select(
        *dict.fromkeys(["doc_id", *keep]), F.octet_length(text).cast("long").alias("_bytes"),
        _bits(F.md5(F.concat(name, F.lit(":"), F.md5(text)))).alias("_hash"))
    numbered = hashed.withColumn("_bits", F.concat(
        "_hash", _bits(F.md5(F.monotonically_increasing_id().cast("string"))))).drop("_hash")
    rows = stage(numbered, "shard-rows")
    found, done = [], 0
    while True:
        to = min(done + bits, 2 * _HASH)
        sums = rows.groupBy(F.substring("_bits", 1, to).alias("_fine")).agg(
            F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
        at = sums.withColumn("_depth", F.explode(F.sequence(F.lit(done), F.lit(to))))
        at = at.withColumn("shard", F.expr("substring(_fine, 1, _depth)"))
        fits = (at.groupBy("_depth", "shard").agg(F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("_n"))
                .where((F.col("shard_bytes") <= limit) | (F.col("_n") == 1) | (F.col("_depth") == 2 * _HASH)))
        leaf = (at.select("_fine", "_depth", "shard").join(fits.drop("_n"), ["_depth", "shard"])
                .groupBy("_fine").agg(F.min(F.struct("_depth", "shard", "shard_bytes")).alias("_leaf")))
        directory = stage(sums.select("_fine").join(leaf, "_fine", "left"), "shard-directory")
        keyed = rows.withColumn("_fine", F.substring("_bits", 1, to))
        small = done == 0  # then at most 2 ** BITS rows
        joined = keyed.join(F.broadcast(directory) if small else directory, "_fine")
        found.append(joined.where(F.col("_leaf").isNotNull()))
        if not directory.where(F.col("_leaf").isNull()).head(1):
            break
        rows = stage(joined.where(F.col("_leaf").isNull()).drop("_fine", "_leaf"), "shard-rows")
        done = to
    out = reduce(DataFrame.unionByName, found)
    return out.select(*[c for c in out.columns if not c.startswith("_")], F.col("_bytes").alias("bytes"),
                      "_leaf.shard", F.col("_leaf._depth").alias("depth"), "_leaf.shard_bytes")


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as Parquet with a folder per shard below ``folder``."""
    kept = assign_shards(docs, limit, keep=docs.columns)
    kept.repartition("shard").write.partitionBy("shard").parquet(folder)
