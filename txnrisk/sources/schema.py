"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

RAW = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

CLEANED = T.StructType([
    *RAW.fields,
    T.StructField("amount_capped", T.DoubleType()),
    T.StructField("is_extreme_amount", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("balance_diff_orig", T.DoubleType()),
    T.StructField("balance_diff_dest", T.DoubleType()),
    T.StructField("zero_balance_after", T.IntegerType()),
    T.StructField("amount_to_balance", T.DoubleType()),
    T.StructField("balance_mismatch", T.IntegerType()),
    T.StructField("dest_type", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("type_encoded", T.IntegerType()),
])

WAREHOUSE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("name_orig", T.StringType()),
    T.StructField("old_balance_orig", MONEY),
    T.StructField("new_balance_orig", MONEY),
    T.StructField("name_dest", T.StringType()),
    T.StructField("old_balance_dest", MONEY),
    T.StructField("new_balance_dest", MONEY),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("is_flagged_fraud", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("balance_diff_orig", MONEY),
    T.StructField("zero_balance_after", T.IntegerType()),
    T.StructField("amount_to_balance", T.DoubleType()),
    T.StructField("balance_mismatch", T.IntegerType()),
    T.StructField("dest_type", T.StringType()),
    T.StructField("is_extreme_amount", T.IntegerType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
])
