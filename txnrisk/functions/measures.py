"""Aggregates shared by the reports, over warehouse column names.

Money and scores are summed as decimals: exact whatever the partitioning, so a
mean is one exact sum over one count and never depends on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from txnrisk.functions.scalars import percent, ratio, rnd

CENTS = "decimal(18,2)"


def rows() -> Column:
    return F.count(F.lit(1))


def frauds() -> Column:
    return F.sum("is_fraud").cast("long")


def fraud_rate(digits: int = 4) -> Column:
    return percent(frauds(), rows(), digits)


def fraud_amount() -> Column:
    """Amount on fraud rows, NULL elsewhere."""
    return F.when(F.col("is_fraud") == 1, F.col("amount"))


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast(CENTS))


def exact_mean(x: Column) -> Column:
    return ratio(exact_sum(x), F.count(x))


def fraud_loss_exact() -> Column:
    """Decimal loss; 0 for a group without fraud, NULL for empty input."""
    return exact_sum(F.coalesce(fraud_amount(), F.lit(0)))


def fraud_loss() -> Column:
    return rnd(fraud_loss_exact(), 2)


def avg_of(x: Column) -> Column:
    return rnd(exact_mean(x), 2)


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")
