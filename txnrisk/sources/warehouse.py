"""The warehouse table: projection, keys, layout, view and introspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from txnrisk.functions import constants as C
from txnrisk.sources import schema as S

CREATED = T.StructField("created_at", T.TimestampType())
# Rows of a bucket: a bucket is read by one task.
BUCKET_ROWS = 4_000_000


def to_warehouse(df: DataFrame, stamp: bool = False) -> DataFrame:
    """Rename, cast and order feature rows as the 23 warehouse columns.

    Without an ``id`` column the row hash stands in. ``stamp`` appends ``created_at``.
    """
    if "id" not in df.columns:
        df = with_row_hash(df)
    renamed = df.withColumnsRenamed(C.WAREHOUSE_NAMES)
    out = renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.WAREHOUSE])
    return out.withColumn("created_at", F.current_timestamp()) if stamp else out


def with_row_hash(df: DataFrame, columns: Sequence[str] = tuple(C.RAW_COLUMNS)) -> DataFrame:
    """64-bit key from the row's content: no shuffle, same on every run.

    Above some 1e8 rows collisions become likely; ``key_collisions`` counts them and
    ``with_sequence`` numbers rows without any.
    """
    return df.withColumn("id", F.xxhash64(*columns))


def key_collisions(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many rows share a key with another row."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding_rows"))


def sequence_buckets(rows: int) -> int:
    """Buckets of about a million rows; from 2^20 buckets on, which keeps their sums broadcastable, larger ones."""
    return max(256, min(-(-rows // 1_000_000), 1 << 20))


def with_sequence(df: DataFrame, columns: Sequence[str] = tuple(C.RAW_COLUMNS),
                  buckets: int | None = None) -> DataFrame:
    """Dense ids 1..n without a global sort.

    Rows are spread over hash buckets, numbered inside each, and shifted by the
    rows of the buckets before. Rows must be distinct over ``columns`` (as they are
    after de-duplication), which makes the numbering repeatable and the buckets even.
    """
    buckets = buckets or sequence_buckets(df.count())
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_b").orderBy(*columns)
    numbered = bucketed.withColumn("_r", F.row_number().over(inside))
    # At most `buckets` rows of two numbers are broadcast.
    joined = numbered.join(F.broadcast(shifts), "_b")
    return joined.select((F.col("_shift") + F.col("_r")).alias("id"), *df.columns)


def cluster_for_reports(df: DataFrame, files: int | None = None) -> DataFrame:
    """Range-cluster on (type, is_fraud, amount) so row-group statistics prune report filters.

    The range key ends in ``id``: one hot (type, is_fraud, amount) still spreads over files.
    """
    keys = ["type", "is_fraud", "amount", "id"]
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def write_warehouse(df: DataFrame, path: str, files: int | None = None) -> None:
    """Store the table as Parquet, one folder per type, clustered inside.

    Bloom filters on the account columns let an account's history skip row groups.
    """
    writer = cluster_for_reports(df, files).write.mode("overwrite").partitionBy("type")
    for column in ("name_orig", "name_dest"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def read_warehouse(spark: SparkSession, path: str, stamp: bool = False) -> DataFrame:
    """The stored table; ``stamp`` reads ``created_at`` too, missing where it was not written."""
    kinds = T.StructType([*S.WAREHOUSE.fields, CREATED]) if stamp else S.WAREHOUSE
    return spark.read.schema(kinds).parquet(path).select(*kinds.names)


def save_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """The table in the session's catalog, stored under ``path``, for SQL users."""
    cluster_for_reports(df).write.mode("overwrite").partitionBy("type").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name).select(*df.columns)


def save_by_sender(df: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """The table in the session's catalog, bucketed and sorted by sender.

    Reports that follow a sender's transactions (``repeat_fraud``, sums by sender) read a bucket
    per task and shuffle nothing by sender; an account's history as a sender reads one bucket.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    (df.repartition(buckets, "name_orig").write.mode("overwrite").bucketBy(buckets, "name_orig")
     .sortBy("name_orig", "step", "id").option("path", path).saveAsTable(name))
    return spark.table(name).select(*df.columns)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def describe_table(df: DataFrame) -> DataFrame:
    """(position, column, dtype, nullable) of any frame."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.lit(f.nullable).alias("nullable"))
             for i, f in enumerate(df.schema)]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))


def table_info(df: DataFrame) -> DataFrame:
    """(position, column, non_null, dtype): values present per column, in one pass."""
    counted = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema])
    cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.col(f.name).alias("non_null"), F.lit(f.dataType.simpleString()).alias("dtype"))
             for i, f in enumerate(df.schema)]
    return counted.select(F.inline(F.array(*cells)))
