"""The ten deeper analyses: signals, running totals, rankings, sequences, report, queue, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from txnrisk.functions import constants as C, measures as M
from txnrisk.functions.scalars import (
    flag, money_text, percent, percent_text, ratio, rnd, weekend_label,
)
from txnrisk.operators.ordering import GROUP_ROWS, ntile, with_neighbour

MIN_SIGNALS = 3
RATIO_SIGNAL = 0.9


def _fraud_only(txns: DataFrame) -> DataFrame:
    return txns.where(F.col("is_fraud") == 1)


def signal_count():
    """How many of the five binary signals a row shows."""
    return (
        flag(F.col("zero_balance_after") == 1)
        + flag(F.col("is_extreme_amount") == 1)
        + flag(F.col("balance_mismatch") == 1)
        + flag(F.col("type").isin(C.FRAUD_TYPES))
        + flag(F.col("amount_to_balance") > RATIO_SIGNAL)
    )


def multi_signal(txns: DataFrame, at_least: int = MIN_SIGNALS) -> DataFrame:
    return (
        txns.withColumn("signal_count", signal_count())
        .where(F.col("signal_count") >= at_least)
        .groupBy("risk_tier", "signal_count")
        .agg(
            M.rows().alias("transactions"),
            M.frauds().alias("confirmed_fraud"),
            M.fraud_rate(2).alias("fraud_rate_pct"),
            M.avg_of(F.col("risk_score")).alias("avg_risk_score"),
        )
        .orderBy(F.desc("signal_count"), F.desc("fraud_rate_pct"), "risk_tier")
    )


def hourly_running_loss(txns: DataFrame) -> DataFrame:
    """Running total and mean of the last three hours present.

    The windows are over hours of the day, 24 rows at the most, so one partition is right.
    Frames count rows: an hour without transactions is skipped, not taken as zero.
    """
    hourly = txns.groupBy("hour_of_day").agg(
        M.fraud_loss_exact().alias("loss"),
        M.count_where(F.col("is_fraud") == 1).alias("hourly_fraud_count"),
    )
    by_hour = Window.orderBy("hour_of_day")
    last3 = by_hour.rowsBetween(-2, 0)
    mean3 = ratio(F.sum("loss").over(last3), F.count("loss").over(last3))
    return hourly.select(
        "hour_of_day",
        rnd(F.col("loss"), 2).alias("fraud_loss"),
        "hourly_fraud_count",
        rnd(F.sum("loss").over(by_hour.rowsBetween(Window.unboundedPreceding, 0)), 2)
        .alias("cumulative_fraud_loss"),
        rnd(mean3, 2).alias("rolling_3hr_avg_loss"),
    ).orderBy("hour_of_day")


def sender_ranking(txns: DataFrame, k: int = 20, tiles: int = 4) -> DataFrame:
    """Senders by fraud loss with rank, dense rank and quartile, first ``k``.

    Ranks of the first k rows depend on those rows alone, and the quartile on the
    number of senders too, so no window ever runs over all senders.
    """
    fraud = _fraud_only(txns)
    senders = fraud.groupBy(F.col("name_orig").alias("sender_account")).agg(
        M.rows().alias("total_transactions"),
        M.frauds().alias("fraud_transactions"),
        M.fraud_loss().alias("total_fraud_loss"),
        M.avg_of(F.col("risk_score")).alias("avg_risk_score"),
    )
    top = senders.orderBy(F.desc("total_fraud_loss"), "sender_account").limit(k)
    by_loss = Window.orderBy(F.desc("total_fraud_loss"))
    in_order = Window.orderBy(F.desc("total_fraud_loss"), "sender_account")
    all_senders = fraud.select("name_orig").distinct().agg(M.rows()).scalar()
    return top.select(
        "*",
        F.rank().over(by_loss).alias("loss_rank"),
        F.dense_rank().over(by_loss).alias("loss_dense_rank"),
        F.row_number().over(in_order).alias("_row"),
        all_senders.alias("_senders"),
    ).select(
        *senders.columns, "loss_rank", "loss_dense_rank",
        ntile(F.col("_row"), F.col("_senders"), tiles).alias("loss_quartile"),
    ).orderBy(F.desc("total_fraud_loss"), "sender_account")


def amount_percentiles(txns: DataFrame, scope: str = "fraud", k: int = 20) -> DataFrame:
    """Percent rank and cumulative distribution of the ``k`` largest amounts.

    ``scope="fraud"`` ranks among fraud rows, ``"all"`` among all rows. What lies above
    a top row is inside the top k; only the number of rows and the ties of the last
    amount come from the whole pool, so it is scanned and never sorted.
    """
    pool = (_fraud_only(txns) if scope == "fraud" else txns).select(
        "id", "type", "amount", "is_fraud", "risk_tier")
    top = pool.orderBy(F.desc("amount"), "id").limit(k)
    last = top.agg(F.min("amount")).scalar()
    sizes = pool.agg(F.struct(
        M.rows().alias("n"), F.count_if(F.col("amount") >= last).alias("reach"))).scalar()
    by_amount = Window.orderBy(F.desc("amount"))
    ranked = top.select(
        "*",
        (F.rank().over(by_amount) - 1).alias("_above"),
        F.count(F.lit(1)).over(Window.partitionBy("amount")).alias("_same"),
        F.min("amount").over(Window.partitionBy()).alias("_last"),
        sizes.alias("_s"),
    )
    n, above = F.col("_s.n"), F.col("_above")
    same = F.when(F.col("amount") == F.col("_last"), F.col("_s.reach") - above).otherwise(F.col("_same"))
    percent_rank = F.coalesce(ratio(n - above - same, n - 1), F.lit(0.0))
    return ranked.select(
        "id", "type", rnd(F.col("amount"), 2).alias("amount"), "is_fraud", "risk_tier",
        rnd(percent_rank * 100, 2).alias("amount_percentile"),
        rnd(ratio(n - above, n) * 100, 2).alias("cumulative_distribution"),
    ).orderBy(F.desc("amount"), "id")


def repeat_fraud(txns: DataFrame, k: int | None = 10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Fraud rows whose sender's previous transaction of any kind was fraud too.

    Only senders with two fraud rows can qualify, so the others are dropped before
    the rows are shuffled by sender.
    """
    candidates = (
        _fraud_only(txns).groupBy("name_orig").agg(M.rows().alias("n"))
        .where(F.col("n") >= 2).select("name_orig")
    )
    pool = txns.select("id", "name_orig", "step", "type", "amount", "is_fraud")
    looked = with_neighbour(pool, "name_orig", "step", ["is_fraud", "amount", "step"],
                            only=candidates, group_rows=group_rows)
    pairs = looked.where((F.col("is_fraud") == 1) & (F.col("prev_is_fraud") == 1)).select(
        "name_orig", "step", "type", F.col("amount").cast("double").alias("amount"),
        "is_fraud", "prev_is_fraud",
        F.col("prev_amount").cast("double").alias("prev_amount"),
        (F.col("step") - F.col("prev_step")).alias("hours_since_last_txn"),
        "id",
    )
    ordered = pairs.orderBy("hours_since_last_txn", "id")
    return (ordered.limit(k) if k else pairs).drop("id")


def above_average_fraud(txns: DataFrame, k: int | None = 20) -> DataFrame:
    """Fraud rows above the mean fraud amount; the mean is a one-row scalar subquery."""
    fraud = _fraud_only(txns)
    mean = fraud.agg(M.exact_mean(F.col("amount"))).scalar()
    amount = F.col("amount").cast("double")
    above = fraud.select("id", "type", "amount", "risk_tier", "risk_score").where(amount > mean)
    if k:
        above = above.orderBy(F.desc("amount"), "id").limit(k)
    return above.select(
        "id", "type", rnd(amount, 2).alias("amount"), "risk_tier", "risk_score",
        rnd(mean, 2).alias("avg_fraud_amount"),
        rnd(ratio(amount, mean), 2).alias("times_above_avg"),
    )


def fraud_report(txns: DataFrame, risk_tier: str = "ALL", fraud_only: bool = False) -> DataFrame:
    """Report by tier and type, for one tier or all, for fraud rows or all."""
    rows = txns if risk_tier == "ALL" else txns.where(F.col("risk_tier") == risk_tier)
    if fraud_only:
        rows = _fraud_only(rows)
    return (
        rows.groupBy("risk_tier", "type")
        .agg(
            M.rows().alias("total_count"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.fraud_loss().alias("fraud_loss"),
            M.avg_of(F.col("amount")).alias("avg_amount"),
            M.avg_of(F.col("risk_score")).alias("avg_risk_score"),
        )
        .orderBy(F.desc("fraud_loss"), "risk_tier", "type")
    )


def investigation_queue(txns: DataFrame) -> DataFrame:
    """High and Critical rows in the investigators' words. Sort where it is read."""
    return txns.where(F.col("risk_tier").isin(C.QUEUE_TIERS)).select(
        F.col("id").alias("case_id"),
        F.col("step").alias("simulation_hour"),
        F.col("type").alias("transaction_type"),
        rnd(F.col("amount"), 2).alias("transaction_amount"),
        F.col("name_orig").alias("sender_account"),
        F.col("name_dest").alias("receiver_account"),
        rnd(F.col("old_balance_orig"), 2).alias("sender_balance_before"),
        rnd(F.col("new_balance_orig"), 2).alias("sender_balance_after"),
        F.col("dest_type").alias("receiver_type"),
        "risk_score", "risk_tier", "hour_of_day",
        weekend_label(F.col("is_weekend")).alias("day_category"),
        F.when(F.col("zero_balance_after") == 1, "YES - Account Drained").otherwise("No")
        .alias("account_drained"),
        F.when(F.col("balance_mismatch") == 1, "YES - Suspicious").otherwise("Normal")
        .alias("balance_consistency"),
        F.col("is_fraud").alias("confirmed_fraud"),
        F.col("is_flagged_fraud").alias("system_flagged"),
    )


def fraud_counts_by_type(txns: DataFrame) -> DataFrame:
    return _fraud_only(txns).groupBy("type").agg(
        M.rows().alias("total_count"), M.frauds().alias("fraud_count"))


def explain_sql(spark: SparkSession, query: str) -> DataFrame:
    """One row, one column ``plan``: the formatted physical plan of a query."""
    return spark.sql(f"EXPLAIN FORMATTED {query}")


def executive_summary(txns: DataFrame) -> DataFrame:
    """One row of headline figures as display text, under spaced column names."""
    critical = F.col("risk_tier") == "Critical"
    kpis = txns.agg(
        M.rows().alias("total"),
        M.frauds().alias("fraud"),
        F.sum("is_flagged_fraud").cast("long").alias("flagged"),
        M.fraud_rate().alias("rate"),
        M.fraud_loss_exact().alias("loss"),
        M.exact_mean(M.fraud_amount()).alias("mean"),
        F.max(F.coalesce(M.fraud_amount(), F.lit(0))).alias("largest"),
        M.count_where(critical).alias("critical"),
        percent(M.count_where(critical & (F.col("is_fraud") == 1)), M.count_where(critical), 2)
        .alias("critical_rate"),
    )
    return kpis.select(
        F.col("total").alias("Total Transactions"),
        F.col("fraud").alias("Fraud Transactions"),
        F.col("flagged").alias("System Flagged"),
        percent_text(F.col("rate"), 4).alias("Fraud Rate"),
        money_text(F.col("loss")).alias("Total Fraud Loss"),
        money_text(F.col("mean")).alias("Avg Fraud Amount"),
        money_text(F.col("largest")).alias("Largest Fraud"),
        F.col("critical").alias("Critical Risk Count"),
        percent_text(F.col("critical_rate"), 2).alias("Critical Tier Fraud Rate"),
    )
