"""All reports over a warehouse table and all profiling tables over a cleaned table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from txnrisk.operators import investigate as I, kpi, profile as P

QUEUE_VIEW = "vw_fraud_investigation"


def reports(txns: DataFrame) -> dict[str, DataFrame]:
    """The twenty reports, lazy. The parameterised one comes with its widest setting."""
    return {
        "kpi_summary": kpi.kpi_summary(txns),
        "fraud_by_type": kpi.fraud_by_type(txns),
        "riskiest_hours": kpi.riskiest_hours(txns),
        "fraud_by_tier": kpi.fraud_by_tier(txns),
        "drain_analysis": kpi.drain_analysis(txns),
        "top_fraud": kpi.top_fraud(txns),
        "loss_trend": kpi.loss_trend(txns),
        "weekend_comparison": kpi.weekend_comparison(txns),
        "flag_outcomes": kpi.flag_outcomes(txns),
        "flag_precision_recall": kpi.flag_precision_recall(txns),
        "multi_signal": I.multi_signal(txns),
        "hourly_running_loss": I.hourly_running_loss(txns),
        "sender_ranking": I.sender_ranking(txns),
        "amount_percentiles": I.amount_percentiles(txns),
        "repeat_fraud": I.repeat_fraud(txns),
        "above_average_fraud": I.above_average_fraud(txns),
        "fraud_report": I.fraud_report(txns),
        "investigation_queue": I.investigation_queue(txns),
        "fraud_counts_by_type": I.fraud_counts_by_type(txns),
        "executive_summary": I.executive_summary(txns),
    }


def profiles(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the profiling charts and summaries of a stored cleaned table."""
    rates = {f"fraud_rate_by_{k}": P.fraud_rate_by(cleaned, k)
             for k in ("type", "zero_balance_after", "hour_of_day", "dest_type")}
    return {
        "describe": P.describe(cleaned),
        "class_distribution": P.class_distribution(cleaned),
        "amount_histogram": P.amount_histogram(cleaned),
        "score_histogram": P.score_histogram(cleaned),
        "reference_markers": P.reference_markers(cleaned),
        "type_counts": P.value_counts(cleaned, "type"),
        "hour_counts": P.value_counts(cleaned, "hour_of_day"),
        "day_counts": P.day_counts(cleaned),
        "tier_counts": P.tier_counts(cleaned),
        **rates,
        "tier_fraud_rate": P.tier_fraud_rate(cleaned),
        "amount_box_stats": P.box_stats(cleaned, F.log1p("amount")),
        "score_density": P.kernel_density(cleaned, "risk_score"),
        "correlation_pairs": P.correlation_pairs(cleaned),
        "top_label_correlations": P.top_label_correlations(cleaned),
        "class_amount_density": P.class_amount_density(cleaned),
        "type_hour_rates": P.type_hour_rates(cleaned),
        "decile_loss": P.decile_loss(cleaned),
        "business_metrics": P.business_metrics(cleaned),
        "insight_summary": P.insight_summary(cleaned),
        "tier_lift": P.lift_by(cleaned, "risk_tier"),
    }


def write_all(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
