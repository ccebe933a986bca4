"""The report and the investigators' queue as objects of the SQL catalog, for users who write SQL.

Both read a table of the catalog, stored or a view, with the warehouse columns. They give the same
rows as ``investigate.fraud_report`` and ``investigate.investigation_queue``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from txnrisk.functions import constants as C

REPORT = "generate_fraud_report"
QUEUE = "vw_fraud_investigation"


def _rounded(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _mean(column: str) -> str:
    return _rounded(f"try_divide(CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE), CAST(count({column}) AS DOUBLE))", 2)


def create_report(spark: SparkSession, table: str, name: str = REPORT, temporary: bool = False) -> str:
    """Create the table function ``name(p_risk_tier, p_fraud_only)`` over ``table``.

    ``p_risk_tier`` is a tier or 'ALL' (the default); ``p_fraud_only`` 1 takes fraud rows only. Arguments may be
    named: ``SELECT * FROM generate_fraud_report(p_fraud_only => 1)``. With literal arguments the filter
    is folded and pushed to the scan.
    """
    share = "try_divide(CAST(sum(is_fraud) AS DOUBLE), CAST(count(1) AS DOUBLE)) * 100.0D"
    loss = "sum(CAST(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END AS DECIMAL(18,2)))"
    spark.sql(f"""
        CREATE OR REPLACE {"TEMPORARY " if temporary else ""}FUNCTION {name}(p_risk_tier STRING DEFAULT 'ALL', p_fraud_only INT DEFAULT 0)
        RETURNS TABLE (risk_tier STRING, type STRING, total_count BIGINT, fraud_count BIGINT, fraud_rate_pct DOUBLE,
                       fraud_loss DOUBLE, avg_amount DOUBLE, avg_risk_score DOUBLE)
        RETURN SELECT risk_tier, type, count(1), CAST(sum(is_fraud) AS BIGINT), {_rounded(share, 4)},
                      {_rounded(loss, 2)}, {_mean("amount")}, {_mean("risk_score")}
               FROM {table}
               WHERE ({name}.p_risk_tier = 'ALL' OR risk_tier = {name}.p_risk_tier)
                 AND ({name}.p_fraud_only = 0 OR is_fraud = 1)
               GROUP BY risk_tier, type""")
    return name


def create_queue(spark: SparkSession, table: str, name: str = QUEUE) -> str:
    """Create the stored view ``name`` of High and Critical rows; its full name. Sort where it is read.

    The full name has the database, as a session view of the same name would hide the stored one.
    """
    name = f"{spark.catalog.currentDatabase()}.{name}"
    tiers = ", ".join(f"'{t}'" for t in C.QUEUE_TIERS)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {name} AS
        SELECT id AS case_id, step AS simulation_hour, type AS transaction_type, {_rounded("amount", 2)} AS transaction_amount,
               name_orig AS sender_account, name_dest AS receiver_account,
               {_rounded("old_balance_orig", 2)} AS sender_balance_before, {_rounded("new_balance_orig", 2)} AS sender_balance_after,
               dest_type AS receiver_type, risk_score, risk_tier, hour_of_day,
               CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_category,
               CASE WHEN zero_balance_after = 1 THEN 'YES - Account Drained' ELSE 'No' END AS account_drained,
               CASE WHEN balance_mismatch = 1 THEN 'YES - Suspicious' ELSE 'Normal' END AS balance_consistency,
               is_fraud AS confirmed_fraud, is_flagged_fraud AS system_flagged
        FROM {table} WHERE risk_tier IN ({tiers})""")
    return name
