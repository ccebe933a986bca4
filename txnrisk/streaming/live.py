"""Scoring and hourly figures for transactions that keep arriving.

Uses the batch features unchanged: they are per-row expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txnrisk.functions.features import type_code
from txnrisk.operators import cleaning
from txnrisk.plans.cleaning_run import Learned, finish
from txnrisk.session import shared_folder
from txnrisk.sources import schema as S

# Time of step 1; the data only counts hours.
EPOCH = "2000-01-03 00:00:00"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType = S.RAW) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def _filled(rows: DataFrame, learned: Learned) -> DataFrame:
    return cleaning.fill_missing(cleaning.fill_zero_balances(rows), learned.fills)


def score_stream(rows: DataFrame, learned: Learned) -> DataFrame:
    """Fill, drop invalid amounts, derive and encode with values learned on past data.

    What is left out, for its amount or an unknown type, is what ``rejected`` returns.
    """
    return finish(cleaning.drop_invalid_amounts(_filled(rows, learned)), learned.cap)


def rejected(rows: DataFrame, learned: Learned) -> DataFrame:
    """The rows that ``score_stream`` leaves out, as filled, and the ``reason``: amount or type."""
    amount = F.col("amount")
    invalid = ~F.coalesce((amount > 0) & ~F.isnan(amount), F.lit(False))
    reason = F.when(invalid, "amount").when(type_code().isNull(), "type")
    return _filled(rows, learned).withColumn("reason", reason).where(F.col("reason").isNotNull())


def hourly_figures(scored: DataFrame, lateness: str | None = None) -> DataFrame:
    """(window_start, transactions, fraud_count, fraud_loss) per hour of event time.

    Every row counts, however late: the state kept is one row per hour. With ``lateness``
    Spark forgets older hours, and rows that come later than that are lost.
    """
    at = F.timestamp_add("HOUR", F.col("step") - 1, F.lit(EPOCH).cast("timestamp"))
    timed = scored.withColumn("event_time", at)
    if lateness is not None:
        timed = timed.withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", "1 hour")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("isFraud").cast("long").alias("fraud_count"),
        F.sum(F.when(F.col("isFraud") == 1, F.col("amount")).otherwise(0).cast("decimal(18,2)"))
        .alias("fraud_loss"),
    ).select(F.col("window.start").alias("window_start"), "transactions", "fraud_count", "fraud_loss")


def run_available(figures: DataFrame, folder: str | None = None) -> DataFrame:
    """Process what has arrived and return the latest figures per window.

    Every micro-batch writes its changed windows under its own number; a repeated batch
    overwrites its own output. Reading keeps the newest version of a window.
    """
    spark = figures.sparkSession
    folder = folder or shared_folder(spark, "hourly")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        figures.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    fields = T.StructType([*figures.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(fields).parquet(f"{folder}/out")
    return written.groupBy("window_start").agg(
        F.max_by(F.struct("transactions", "fraud_count", "fraud_loss"), F.col("batch")).alias("w")
    ).select("window_start", "w.*")
