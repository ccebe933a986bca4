"""Shared SQL: the orders mapping, features, warehouse columns and rounding helpers."""

from __future__ import annotations


def r(expr: str, digits: int) -> str:
    """Round half away from zero through a decimal, as double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0))"


def pct(num: str, den: str, digits: int) -> str:
    return r(f"{div(num, den)} * 100", digits)


FRAUDS = "CAST(sum(is_fraud) AS BIGINT)"
RATE = pct("sum(is_fraud)", "count(*)", 4)
LOSS_RAW = "sum(CASE is_fraud WHEN 1 THEN amount ELSE 0 END)"
LOSS = r(LOSS_RAW, 2)
SCORE = "CAST(risk_score AS DECIMAL(18,2))"


def mean(expr: str, where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return r(div(f"sum({expr}){f}", f"count({expr}){f}"), 2)


SOURCE = """
src AS (
  SELECT o_orderkey AS id, o_custkey AS ck, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
              WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN'
              WHEN '5-LOW' THEN 'DEBIT' END AS type,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 24 + o_orderkey % 24 AS hours
  FROM orders),
marked AS (
  SELECT *, type IN ('TRANSFER', 'CASH_OUT') AND ck % 20 = 0 AS bad,
         CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND ck % 20 = 0 AND id % 5 <> 0
              THEN cents ELSE cents * (id % 7) END AS oo,
         CASE WHEN type = 'PAYMENT' THEN 0 ELSE (id % 9) * 10000000 END AS od
  FROM src),
raw AS (
  SELECT id, CAST((hours % 744 + 744) % 744 + 1 AS INTEGER) AS step, type,
         CAST(cents AS DOUBLE) / 100 AS amount, 'C' || ck AS "nameOrig",
         CAST(oo AS DOUBLE) / 100 AS "oldbalanceOrg",
         CAST(CASE WHEN type = 'CASH_IN' THEN oo + cents ELSE greatest(oo - cents, 0) END AS DOUBLE) / 100
           AS "newbalanceOrig",
         CASE WHEN type = 'PAYMENT' THEN 'M' || ((id * 7) % 97)
              ELSE 'C' || ((ck * 31 + 7) % 1009) END AS "nameDest",
         CAST(od AS DOUBLE) / 100 AS "oldbalanceDest",
         CAST(CASE WHEN type = 'PAYMENT' THEN 0 WHEN type = 'CASH_IN' THEN greatest(od - cents, 0)
              ELSE od + cents END AS DOUBLE) / 100 AS "newbalanceDest",
         CAST(bad AS INTEGER) AS "isFraud",
         CAST(type = 'TRANSFER' AND cents > 40000000 AS INTEGER) AS "isFlaggedFraud"
  FROM marked)"""


def features(source: str, name: str) -> str:
    """Three CTEs that add the derived columns to ``source``; the last one is ``name``."""
    score = ("least(greatest(zero_balance_after * 35.0::DOUBLE"
             " + least(greatest(coalesce(amount_to_balance, 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 25.0::DOUBLE"
             " + is_extreme_amount * 20.0::DOUBLE"
             " + CAST(type IN ('CASH_OUT', 'TRANSFER') AS INTEGER) * 15.0::DOUBLE"
             " + \"isFlaggedFraud\" * 5.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE)")
    return f"""
{name}_a AS (
  SELECT *, CAST(amount > 200000 AS INTEGER) AS is_extreme_amount,
         CAST(step % 24 AS INTEGER) AS hour_of_day,
         CAST((step // 24) % 7 AS INTEGER) AS day_of_week,
         CAST((step // 24) % 7 >= 5 AS INTEGER) AS is_weekend,
         {r('"oldbalanceOrg" - "newbalanceOrig"', 2)} AS balance_diff_orig,
         {r('"newbalanceDest" - "oldbalanceDest"', 2)} AS balance_diff_dest,
         CAST("newbalanceOrig" = 0 AS INTEGER) AS zero_balance_after,
         {r(div('amount', '("oldbalanceOrg" + 1)'), 6)} AS amount_to_balance,
         CASE WHEN "nameDest" LIKE 'M%' THEN 'Merchant' ELSE 'Customer' END AS dest_type
  FROM {source}),
{name}_b AS (
  SELECT *, CAST(abs(balance_diff_orig - amount) > 1 AS INTEGER) AS balance_mismatch,
         {r(score, 2)} AS risk_score
  FROM {name}_a),
{name} AS (
  SELECT *, CASE WHEN risk_score <= 25 THEN 'Low' WHEN risk_score <= 50 THEN 'Medium'
                 WHEN risk_score <= 75 THEN 'High' WHEN risk_score <= 100 THEN 'Critical' END AS risk_tier
  FROM {name}_b)"""


TXN = """
txn AS (
  SELECT id, step, type, CAST(amount AS DECIMAL(18,2)) AS amount, "nameOrig" AS name_orig,
         CAST("oldbalanceOrg" AS DECIMAL(18,2)) AS old_balance_orig,
         CAST("newbalanceOrig" AS DECIMAL(18,2)) AS new_balance_orig, "nameDest" AS name_dest,
         CAST("oldbalanceDest" AS DECIMAL(18,2)) AS old_balance_dest,
         CAST("newbalanceDest" AS DECIMAL(18,2)) AS new_balance_dest,
         "isFraud" AS is_fraud, "isFlaggedFraud" AS is_flagged_fraud, hour_of_day, day_of_week,
         is_weekend, CAST(balance_diff_orig AS DECIMAL(18,2)) AS balance_diff_orig,
         zero_balance_after, amount_to_balance, balance_mismatch, dest_type, is_extreme_amount,
         risk_score, risk_tier
  FROM feat)"""

DIRTY = """
dirty AS (
  SELECT step, type, CASE WHEN id % 1000 = 3 THEN 0.0::DOUBLE ELSE amount END AS amount, "nameOrig",
         "oldbalanceOrg", "newbalanceOrig", "nameDest",
         CASE WHEN id % 125 = 0 THEN NULL ELSE "oldbalanceDest" END AS "oldbalanceDest",
         CASE WHEN id % 187 = 0 THEN NULL ELSE "newbalanceDest" END AS "newbalanceDest",
         "isFraud", "isFlaggedFraud"
  FROM raw, (VALUES (1), (2)) AS copies(n)
  WHERE n = 1 OR id % 3000 = 1)"""

VALID = """
filled AS (
  SELECT DISTINCT * REPLACE (coalesce("oldbalanceDest", 0) AS "oldbalanceDest",
                             coalesce("newbalanceDest", 0) AS "newbalanceDest")
  FROM dirty),
valid AS (SELECT * FROM filled WHERE amount > 0),
cap AS (SELECT quantile_cont(amount, 0.999) AS cap FROM valid)"""

TYPE_CODE = ("CASE type WHEN 'CASH_OUT' THEN 0 WHEN 'PAYMENT' THEN 1 WHEN 'CASH_IN' THEN 2 "
             "WHEN 'TRANSFER' THEN 3 WHEN 'DEBIT' THEN 4 END")

RAW = f"WITH {SOURCE.strip()}"
FEAT = f"{RAW},{features('raw', 'feat')}"
WAREHOUSE = f"{FEAT},{TXN}"
SOILED = f"{RAW},{DIRTY}"
CLEANED = f"""{SOILED},{VALID},{features('valid', 'done')},
cleaned AS (
  SELECT step, type, amount, "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
         "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
         {r('least(amount, cap)', 5)} AS amount_capped, is_extreme_amount, hour_of_day, day_of_week,
         is_weekend, balance_diff_orig, balance_diff_dest, zero_balance_after, amount_to_balance,
         balance_mismatch, dest_type, risk_score, risk_tier, {TYPE_CODE} AS type_encoded
  FROM done, cap)"""
SCORED = f"{FEAT},\nscored AS (SELECT id, \"isFraud\" AS label, risk_score / 100 AS score FROM feat)"
