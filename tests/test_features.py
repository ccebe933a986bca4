import pytest
from pyspark.sql import functions as F

from rows import raw
from txnrisk.functions import features
from txnrisk.functions.scalars import money_text, percent_text, position, ratio, rnd
from txnrisk.operators.evaluate import alert_priority


def one(spark, **change):
    return features.add_features(raw(spark, change)).first()


@pytest.mark.parametrize("score,tier", [
    (0.0, "Low"), (25.0, "Low"), (25.01, "Medium"), (50.0, "Medium"), (50.01, "High"),
    (75.0, "High"), (75.01, "Critical"), (100.0, "Critical"), (None, None)])
def test_tier_edges(spark, score, tier):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(features.risk_tier(F.col("s"))).first()[0] == tier


@pytest.mark.parametrize("p,band", [
    (0.0, None), (0.3, "Low"), (0.300001, "Medium"), (0.6, "Medium"), (0.85, "High"),
    (0.8500001, "Critical"), (1.0, "Critical")])
def test_priority_edges(spark, p, band):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(alert_priority(F.col("p"))).first()[0] == band


@pytest.mark.parametrize("x,digits,want", [
    (1.005, 2, 1.01), (2.675, 2, 2.68), (0.125, 2, 0.13), (-0.125, 2, -0.13), (2.0, 4, 2.0)])
def test_rounding(spark, x, digits, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(rnd(F.col("x"), digits)).first()[0] == want


def test_text(spark):
    row = spark.range(1).select(
        money_text(F.lit(1234567.125)).alias("m"), percent_text(F.lit(0.6), 4).alias("p"),
        percent_text(F.lit(None).cast("double"), 4).alias("n"), ratio(F.lit(1), F.lit(0)).alias("z"),
        position(F.lit("x"), ["a"]).alias("absent")).first()
    assert (row["m"], row["p"], row["n"], row["z"], row["absent"]) == ("$1,234,567.13", "0.6000%", None, None, 0)


def test_thresholds_are_strict(spark):
    assert one(spark, amount=200000.0)["is_extreme_amount"] == 0
    assert one(spark, amount=200000.01)["is_extreme_amount"] == 1
    assert one(spark, amount=100.0, oldbalanceOrg=500.0, newbalanceOrig=399.0)["balance_mismatch"] == 0
    assert one(spark, amount=100.0, oldbalanceOrg=500.0, newbalanceOrig=398.99)["balance_mismatch"] == 1


def test_balances_have_opposite_signs(spark):
    row = one(spark, oldbalanceOrg=10.0, newbalanceOrig=4.0, oldbalanceDest=1.0, newbalanceDest=9.0)
    assert (row["balance_diff_orig"], row["balance_diff_dest"]) == (6.0, 8.0)


def test_time(spark):
    row = one(spark, step=24 * 5 + 3)
    assert (row["hour_of_day"], row["day_of_week"], row["is_weekend"]) == (3, 5, 1)
    assert one(spark, step=24 * 7)["day_of_week"] == 0


def test_division_by_zero_counts_as_full_ratio(spark):
    row = one(spark, oldbalanceOrg=-1.0, amount=10.0, newbalanceOrig=5.0)
    assert row["amount_to_balance"] is None
    assert row["risk_score"] == 25.0


def test_full_score(spark):
    row = one(spark, type="TRANSFER", amount=300000.0, oldbalanceOrg=300000.0, newbalanceOrig=0.0,
              isFlaggedFraud=1, nameDest="C9")
    assert row["risk_score"] == pytest.approx(100.0, abs=0.01)
    assert (row["risk_tier"], row["dest_type"]) == ("Critical", "Customer")


def test_score_stays_in_range(spark, sf):
    from txnrisk.plans.catalog import feat
    lo, hi = feat(spark, sf).agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0 <= lo <= hi <= 100
