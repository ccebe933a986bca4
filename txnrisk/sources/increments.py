"""A stored table that grows by batches and whose ids go on counting.

Ids are reserved before rows are written: the ledger names for each batch its first id and its
number of rows, and the highest id given out is what a new batch continues from. A batch that
failed half-way and is tried again finds its reservation and takes the same ids; one that was
written already is left alone. Readers see batches that the ledger says are written. Ids of a
batch that never came back are left out, as an interrupted insert leaves them out. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txnrisk.operators import ordering
from txnrisk.session import stage
from txnrisk.sources import warehouse

RESERVED, WRITTEN = "reserved", "written"
LEDGER = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("at", T.TimestampType()),
])


def _note(spark: SparkSession, folder: str, batch: str, first: int, rows: int, state: str) -> None:
    line = spark.createDataFrame([(batch, first, rows, state)], "batch string, first_id long, rows long, state string")
    line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, first_id, rows, state, at): a line when a batch's ids are reserved and one when it is written."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def high_water(spark: SparkSession, folder: str) -> int:
    """The highest id given out so far, 0 if none."""
    return ledger(spark, folder).agg(F.max(F.col("first_id") + F.col("rows") - 1)).first()[0] or 0


def number_rows(df: DataFrame, order: str | None, tie: str, columns: Sequence[str]) -> DataFrame:
    """``number`` from 1 on, by (``order``, ``tie``) if given, else by a hash of ``columns``; the same on every run."""
    if order:
        ranked = ordering.global_rank(df, order, tie=tie)
        return ranked.select(*df.columns, F.col("row_number").alias("number"))
    return warehouse.with_sequence(df, columns).withColumnRenamed("id", "number")


def append_batch(df: DataFrame, folder: str, batch: str, order: str | None = None, tie: str = "id",
                 key: str = "id") -> tuple[int, int]:
    """Store ``df`` as one batch of the table in ``folder``; (first id, rows) of the batch.

    ``key`` is the id column to be added, beside ``created_at``. With ``order`` the ids follow (``order``,
    ``tie``), both numeric and ``tie`` unique; without, rows must be distinct and follow a hash of
    all columns. Either way a retried batch gets the same ids row by row. A batch that comes
    back with another number of rows is refused.
    """
    spark = df.sparkSession
    held = stage(df, "batch")
    rows = held.count()
    known = {r["state"]: r for r in ledger(spark, folder).where(F.col("batch") == batch).collect()}  # two lines at the most
    for r in known.values():
        if r["rows"] != rows:
            raise ValueError(f"batch {batch} had {r['rows']} rows before and now has {rows}")
    if WRITTEN in known:
        return known[WRITTEN]["first_id"], rows
    if RESERVED in known:
        first = known[RESERVED]["first_id"]
    else:
        first = high_water(spark, folder) + 1
        _note(spark, folder, batch, first, rows, RESERVED)
    numbered = number_rows(held, order, tie, held.columns)
    numbered.select((F.col("number") + (first - 1)).cast("long").alias(key), *held.columns,
                    F.current_timestamp().alias("created_at")
                    ).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    _note(spark, folder, batch, first, rows, WRITTEN)
    return first, rows


def read_appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All written rows: ``schema`` (with the id column and, if wanted, ``created_at``) and their ``batch``."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(f"{folder}/rows")
    written = ledger(spark, folder).where(F.col("state") == WRITTEN).select("batch")
    return rows.join(written, "batch", "left_semi").select(*schema.names, "batch")
