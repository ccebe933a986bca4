"""Derived transaction features. All are per-row expressions, so they also run on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.functions.scalars import clip, flag, ratio, rnd


def is_extreme_amount() -> Column:
    return flag(F.col("amount") > C.EXTREME_AMOUNT)


def risk_score() -> Column:
    """Weighted sum of five signals, 0 to 100.

    A ratio that could not be computed (opening balance of exactly -1) counts as full.
    """
    # Never NULL, so the plain functions do, and the ratio is mentioned once.
    used = F.least(F.greatest(F.coalesce(F.col("amount_to_balance"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    total = (
        F.col("zero_balance_after") * float(C.WEIGHT_DRAINED)
        + used * float(C.WEIGHT_RATIO)
        + F.col("is_extreme_amount") * float(C.WEIGHT_EXTREME)
        + flag(F.col("type").isin(C.FRAUD_TYPES)) * float(C.WEIGHT_TYPE)
        + F.col("isFlaggedFraud") * float(C.WEIGHT_FLAGGED)
    )
    return rnd(clip(total, 0.0, 100.0), 2)


def risk_tier(score: Column) -> Column:
    """Tier of a 0 to 100 score: [0,25] (25,50] (50,75] (75,100].

    One expression of the score rather than a chain of comparisons: a filter on the
    tier is pushed below the projection, and a chain would work the score out four times.
    """
    labels = F.array(*[F.lit(t) for t in (C.RISK_TIERS[0], *C.RISK_TIERS)])  # 0 is in the lowest tier
    return F.get(labels, F.ceil(score / C.RISK_TIER_WIDTH).cast("int"))


def add_features(df: DataFrame) -> DataFrame:
    """Time, balance and risk columns of a raw-shaped frame.

    Adds ``is_extreme_amount`` first when the frame does not have it yet.
    """
    if "is_extreme_amount" not in df.columns:
        df = df.withColumn("is_extreme_amount", is_extreme_amount())
    step = F.col("step")
    day = F.pmod(F.floor(step / 24), F.lit(7)).cast("int")
    basics = df.withColumns({
        "hour_of_day": F.pmod(step, F.lit(24)).cast("int"),
        "day_of_week": day,
        "is_weekend": flag(day >= 5),
        "balance_diff_orig": rnd(F.col("oldbalanceOrg") - F.col("newbalanceOrig"), 2),
        "balance_diff_dest": rnd(F.col("newbalanceDest") - F.col("oldbalanceDest"), 2),
        "zero_balance_after": flag(F.col("newbalanceOrig") == 0),
        "amount_to_balance": rnd(ratio(F.col("amount"), F.col("oldbalanceOrg") + 1), 6),
        "dest_type": F.when(F.col("nameDest").startswith("M"), "Merchant").otherwise("Customer"),
    })
    mismatch = F.abs(F.col("balance_diff_orig") - F.col("amount")) > C.MISMATCH_TOLERANCE
    scored = basics.withColumns({"balance_mismatch": flag(mismatch), "risk_score": risk_score()})
    return scored.withColumn("risk_tier", risk_tier(F.col("risk_score")))


def type_code() -> Column:
    """Fixed code of the transaction type, NULL for an unknown one."""
    pairs = [F.lit(v) for item in C.TYPE_CODES.items() for v in item]
    return F.element_at(F.create_map(*pairs), F.col("type"))


def log_amount(name: str = "amount") -> Column:
    return F.log1p(F.col(name))
