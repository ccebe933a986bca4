"""Audit before cleaning and validation after it, as long tables of checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.functions.scalars import percent, rnd, without_nan
from txnrisk.operators.quantiles import exact_quantiles


def missing_report(df: DataFrame) -> DataFrame:
    """(column, count, pct) for the columns that have missing values."""
    df = without_nan(df)
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = counted.unpivot(["_rows"], names, "column", "count").where(F.col("count") > 0)
    return long.select("column", "count", percent(F.col("count"), F.col("_rows"), 2).alias("pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each exact copy; NULLs count as equal.

    Copies collapse in the map-side aggregate, so a row repeated without end costs nothing more.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def invalid_amounts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("amount") <= 0).alias("invalid_amounts"))


def amount_outliers(df: DataFrame, q: float = C.CAP_QUANTILE) -> DataFrame:
    """One row: the exact quantile of amount and the rows above it."""
    cut = exact_quantiles(df, {"amount": F.col("amount")}, [q])["amount"][0]
    return df.agg(
        F.round(F.lit(cut).cast("decimal(38,10)"), 6).cast("double").alias("quantile_value"),
        F.count_if(F.col("amount") > F.lit(cut)).alias("outliers"),
    )


def fraud_share(df: DataFrame) -> DataFrame:
    return df.agg(percent(F.sum("isFraud"), F.count("isFraud"), 4).alias("fraud_rate_pct"))


def type_distribution(df: DataFrame, fraud_only: bool = False) -> DataFrame:
    """(type, count), most frequent first, without NULL."""
    rows = df.where(F.col("isFraud") == 1) if fraud_only else df
    return (
        rows.where(F.col("type").isNotNull()).groupBy("type")
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")
    )


def audit(raw: DataFrame) -> DataFrame:
    """(check, subject, value) of every audit item."""
    cut = exact_quantiles(raw, {"amount": F.col("amount")}, [C.CAP_QUANTILE])["amount"][0]
    names = raw.columns
    one = raw.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("amount") <= 0).cast("double").alias("invalid_amounts"),
        F.count_if(F.col("amount") > F.lit(cut)).cast("double").alias("amount_outliers_q999"),
        percent(F.sum("isFraud"), F.count("isFraud"), 4).alias("fraud_rate_pct"),
        *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in names],
    )

    def entry(check, subject, value):
        return F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"),
                        value.cast("double").alias("value"))

    single = [entry(c, "", F.col(c)) for c in ("invalid_amounts", "amount_outliers_q999", "fraud_rate_pct")]
    missing = []
    for c in names:
        n = F.col(f"`null {c}`")
        missing += [F.when(n > 0, entry("missing_count", c, n)),
                    F.when(n > 0, entry("missing_pct", c, percent(n, F.col("_rows"), 2)))]
    scalars = one.select(F.inline(F.array_compact(F.array(*single, *missing))))

    copies = duplicate_rows(raw).select(F.inline(F.array(entry("duplicates", "", F.col("duplicate_rows")))))
    by_type = raw.where(F.col("type").isNotNull()).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("isFraud") == 1).alias("f"))

    def typed(check, value):
        return F.struct(F.lit(check).alias("check"), F.col("type").alias("subject"),
                        value.cast("double").alias("value"))

    types = by_type.select(F.inline(F.array_compact(F.array(
        typed("type_distribution", F.col("n")),
        F.when(F.col("f") > 0, typed("fraud_by_type", F.col("f"))),
    ))))
    return scalars.unionByName(copies).unionByName(types)


def cleaned_summary(clean: DataFrame) -> DataFrame:
    """One row: size, fraud share and amount range of a cleaned table."""
    return clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(clean.columns)).alias("columns"),
        F.sum("isFraud").cast("long").alias("fraud_rows"),
        percent(F.sum("isFraud"), F.count("isFraud"), 4).alias("fraud_rate_pct"),
        rnd(F.min("amount"), 2).alias("min_amount"),
        rnd(F.max("amount"), 2).alias("max_amount"),
    )


def validate(clean: DataFrame, strict: bool = False, key: Sequence[str] | None = None) -> DataFrame:
    """(check, violations, passed) of the post-cleaning conditions.

    ``strict`` raises on the first failed check; it runs the checks at once.
    """
    names = list(key or clean.columns)
    known = "type_encoded" in clean.columns
    scored = "risk_score" in clean.columns
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in clean.columns), F.lit(0))
    counts = clean.agg(
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("no_missing_values"),
        F.count_if(~(F.coalesce(F.col("amount"), F.lit(0)) > 0)).alias("amounts_positive"),
        F.lit(0 if scored else 1).cast("long").alias("risk_score_present"),
        (F.count_if(F.col("type_encoded").isNull()) if known else F.count(F.lit(1))).alias("types_encoded"),
    )
    checks = ["no_missing_values", "amounts_positive", "risk_score_present", "types_encoded"]
    long = counts.unpivot([], checks, "check", "violations")
    copies = duplicate_rows(clean.select(*names)).select(
        F.lit("no_duplicate_rows").alias("check"), F.col("duplicate_rows").alias("violations"))
    report = long.unionByName(copies).withColumn("passed", F.col("violations") == 0)
    if strict:
        failed = [r["check"] for r in report.where(~F.col("passed")).collect()]
        if failed:
            raise ValueError(f"validation failed: {', '.join(sorted(failed))}")
    return report
