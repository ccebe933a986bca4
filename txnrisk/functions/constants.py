"""Names, codes, weights, edges and labels that results depend on."""

from __future__ import annotations

# Raw transaction columns, in file order. "oldbalanceOrg" has no second "i"; "newbalanceOrig" has.
RAW_COLUMNS = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]

# Transaction types and their codes.
TYPE_CODES = {"CASH_OUT": 0, "PAYMENT": 1, "CASH_IN": 2, "TRANSFER": 3, "DEBIT": 4}
FRAUD_TYPES = ["CASH_OUT", "TRANSFER"]

# Destination balances that mean "new account" when missing.
ZERO_FILL_COLUMNS = ["oldbalanceDest", "newbalanceDest"]

EXTREME_AMOUNT = 200000
CAP_QUANTILE = 0.999
MISMATCH_TOLERANCE = 1

# Risk score weights; they add up to 100.
WEIGHT_DRAINED = 35
WEIGHT_RATIO = 25
WEIGHT_EXTREME = 20
WEIGHT_TYPE = 15
WEIGHT_FLAGGED = 5

# Right-closed bins with their labels. Risk tiers are equally wide: 25, 50, 75, 100.
RISK_TIERS = ["Low", "Medium", "High", "Critical"]
RISK_TIER_WIDTH = 25
ALERT_PRIORITIES = ["Low", "Medium", "High", "Critical"]
ALERT_EDGES = [0.3, 0.6, 0.85, 1.0]
QUEUE_TIERS = ["High", "Critical"]

DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Columns described, correlated and learned from.
DESCRIBED_COLUMNS = [
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "risk_score",
]
CORRELATED_COLUMNS = [
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "balance_diff_orig", "balance_diff_dest", "zero_balance_after", "amount_to_balance",
    "risk_score", "hour_of_day", "is_weekend", "is_extreme_amount", "isFraud",
]
MODEL_FEATURES = [
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "balance_diff_orig", "balance_diff_dest", "zero_balance_after", "amount_to_balance",
    "balance_mismatch", "is_extreme_amount", "hour_of_day", "is_weekend", "type_encoded",
]
SEED = 42

# Text tokens a CSV reader takes for a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Raw name -> warehouse name.
WAREHOUSE_NAMES = {
    "nameOrig": "name_orig",
    "oldbalanceOrg": "old_balance_orig",
    "newbalanceOrig": "new_balance_orig",
    "nameDest": "name_dest",
    "oldbalanceDest": "old_balance_dest",
    "newbalanceDest": "new_balance_dest",
    "isFraud": "is_fraud",
    "isFlaggedFraud": "is_flagged_fraud",
}
