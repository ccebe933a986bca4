"""The ten business reports over the warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.functions import constants as C, measures as M
from txnrisk.functions.scalars import percent, position, rnd, weekend_label


def kpi_summary(txns: DataFrame) -> DataFrame:
    flagged = F.sum("is_flagged_fraud").cast("long")
    return txns.agg(
        M.rows().alias("total_transactions"),
        M.frauds().alias("total_fraud_count"),
        M.fraud_rate().alias("fraud_rate_pct"),
        M.fraud_loss().alias("total_fraud_loss"),
        M.avg_of(M.fraud_amount()).alias("avg_fraud_amount"),
        M.avg_of(F.when(F.col("is_fraud") == 0, F.col("amount"))).alias("avg_legit_amount"),
        flagged.alias("system_flagged_count"),
        percent(flagged, M.frauds(), 2).alias("flag_coverage_pct"),
    )


def fraud_by_type(txns: DataFrame) -> DataFrame:
    """Loss share is against the type's own turnover, not the grand total."""
    return (
        txns.groupBy(F.col("type").alias("transaction_type"))
        .agg(
            M.rows().alias("total_count"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.fraud_loss().alias("fraud_loss"),
            M.avg_of(M.fraud_amount()).alias("avg_fraud_amount"),
            percent(M.fraud_loss_exact(), M.exact_sum(F.col("amount")), 4).alias("fraud_loss_pct_of_total"),
        )
        .orderBy(F.desc("fraud_loss"), "transaction_type")
    )


def riskiest_hours(txns: DataFrame, k: int = 10) -> DataFrame:
    return (
        txns.groupBy("hour_of_day")
        .agg(
            M.rows().alias("total_transactions"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.fraud_loss().alias("fraud_loss"),
        )
        .orderBy(F.desc("fraud_rate_pct"), "hour_of_day")
        .limit(k)
    )


def fraud_by_tier(txns: DataFrame) -> DataFrame:
    worst_first = C.RISK_TIERS[::-1]
    return (
        txns.groupBy("risk_tier")
        .agg(
            M.rows().alias("total_count"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.avg_of(F.col("risk_score")).alias("avg_risk_score"),
            M.fraud_loss().alias("fraud_loss"),
        )
        .orderBy(position(F.col("risk_tier"), worst_first))
    )


def drain_analysis(txns: DataFrame) -> DataFrame:
    return (
        txns.where(F.col("type").isin(C.FRAUD_TYPES))
        .groupBy("zero_balance_after")
        .agg(
            M.rows().alias("transaction_count"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.avg_of(F.col("amount")).alias("avg_amount"),
            M.fraud_loss().alias("fraud_loss"),
        )
        .orderBy(F.desc("zero_balance_after"))
    )


def top_fraud(txns: DataFrame, k: int = 20) -> DataFrame:
    """Largest fraud rows first: the review work queue."""
    money = {"amount": "amount", "old_balance_orig": "sender_balance_before",
             "new_balance_orig": "sender_balance_after"}
    shown = {name: rnd(F.col(name), 2).alias(alias) for name, alias in money.items()}
    return (
        txns.where(F.col("is_fraud") == 1)
        .orderBy(F.desc("amount"), "id")
        .limit(k)
        .select(
            "id", "step", "type", shown["amount"],
            F.col("name_orig").alias("sender_account"),
            F.col("name_dest").alias("receiver_account"),
            shown["old_balance_orig"], shown["new_balance_orig"],
            "risk_score", "risk_tier", "hour_of_day",
            weekend_label(F.col("is_weekend")).alias("day_type"),
        )
    )


def loss_trend(txns: DataFrame, k: int = 50) -> DataFrame:
    return (
        txns.groupBy(F.col("step").alias("simulation_hour"))
        .agg(
            M.rows().alias("total_transactions"),
            M.frauds().alias("fraud_count"),
            M.fraud_loss().alias("fraud_loss"),
            M.fraud_rate().alias("fraud_rate_pct"),
        )
        .orderBy("simulation_hour")
        .limit(k)
    )


def weekend_comparison(txns: DataFrame) -> DataFrame:
    return (
        txns.groupBy("is_weekend")
        .agg(
            M.rows().alias("total_transactions"),
            M.frauds().alias("fraud_count"),
            M.fraud_rate().alias("fraud_rate_pct"),
            M.avg_of(M.fraud_amount()).alias("avg_fraud_amount"),
            M.fraud_loss().alias("total_fraud_loss"),
        )
        .withColumn("day_category", weekend_label(F.col("is_weekend")))
        .select("day_category", "total_transactions", "fraud_count", "fraud_rate_pct",
                "avg_fraud_amount", "total_fraud_loss")
    )


def flag_outcomes(txns: DataFrame) -> DataFrame:
    fraud, flagged = F.col("is_fraud") == 1, F.col("is_flagged_fraud") == 1
    hit = F.when(flagged, "True Positive (Caught!)").otherwise("False Negative (MISSED!)")
    miss = F.when(flagged, "False Positive (False Alarm)").otherwise("True Negative (Correct)")
    return (
        txns.groupBy("is_fraud", "is_flagged_fraud")
        .agg(M.rows().alias("count"))
        .withColumn("outcome", F.when(fraud, hit).otherwise(miss))
        .orderBy(F.desc("is_fraud"), F.desc("is_flagged_fraud"))
    )


def flag_precision_recall(txns: DataFrame) -> DataFrame:
    fraud, flagged = F.col("is_fraud") == 1, F.col("is_flagged_fraud") == 1
    cells = txns.agg(
        M.count_where(fraud & flagged).alias("true_positives"),
        M.count_where(~fraud & flagged).alias("false_positives"),
        M.count_where(fraud & ~flagged).alias("false_negatives"),
        M.count_where(~fraud & ~flagged).alias("true_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return cells.withColumns({
        "precision_pct": percent(tp, tp + fp, 2),
        "recall_pct": percent(tp, tp + fn, 2),
    })
