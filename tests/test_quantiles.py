import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from txnrisk.operators.quantiles import exact_median, exact_quantiles, kth_smallest, most_common

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


@pytest.mark.parametrize("accuracy,bins", [(500, 2048), (10_000, 16), (3, 64), (2, 7)])
def test_equals_numpy(spark, accuracy, bins):
    rng = np.random.default_rng(5)
    values = np.concatenate([
        rng.lognormal(8, 3, 400).round(2), np.full(300, 123.45), -rng.random(50), [1e12]])
    got = exact_quantiles(frame(spark, values), {"v": F.col("v")}, PROBS, accuracy, bins)["v"]
    assert got == pytest.approx([np.quantile(values, p) for p in PROBS], rel=1e-12)


@settings(max_examples=12, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6, allow_subnormal=False), min_size=1, max_size=40),
       p=st.floats(0, 1))
def test_any_values(spark, values, p):
    got = exact_quantiles(frame(spark, values), {"v": F.col("v")}, [p], accuracy=2, bins=3)["v"][0]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_streams_are_independent(spark):
    df = spark.range(1, 101).select("id", (F.col("id") % 2).alias("g"))
    got = exact_quantiles(df, {
        "odd": F.when(F.col("g") == 1, F.col("id")),
        "even": F.when(F.col("g") == 0, F.col("id")),
        "none": F.when(F.col("g") == 9, F.col("id")),
    }, [0.5])
    assert got == {"odd": [50.0], "even": [51.0], "none": [None]}


def test_kth_smallest(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    for k in (1, 2, 500, 1000):
        assert kth_smallest(df, {"v": F.col("v")}, {"v": (k, 1000)}, accuracy=5, bins=4)["v"] == k - 1


def test_median_and_mode(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", None), ("b", 4), (None, 9)], "s string, n int")
    assert most_common(df, "s") == "a"
    assert exact_median(df, "n") == 3.0
    assert most_common(df.where("s is null"), "s") is None
