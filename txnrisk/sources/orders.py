"""Deterministic mapping of an orders table to payment transactions.

One order is one transaction. Money is worked out in whole cents, so every engine
gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.functions import constants as C

# Order priority -> transaction type.
PRIORITY_TYPES = {
    "1-URGENT": "TRANSFER", "2-HIGH": "CASH_OUT", "3-MEDIUM": "PAYMENT",
    "4-NOT SPECIFIED": "CASH_IN", "5-LOW": "DEBIT",
}


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """``id`` plus the raw columns, clean."""
    pairs = [F.lit(v) for item in PRIORITY_TYPES.items() for v in item]
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    base = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("ck"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.element_at(F.create_map(*pairs), F.col("o_orderpriority")).alias("type"),
        (F.pmod(days * 24 + F.col("o_orderkey") % 24, F.lit(744)) + 1).cast("int").alias("step"),
    )
    k, ck, cents, kind = F.col("id"), F.col("ck"), F.col("cents"), F.col("type")
    fraud = kind.isin(C.FRAUD_TYPES) & (ck % 20 == 0)
    marked = base.withColumns({
        "isFraud": F.when(fraud, 1).otherwise(0),
        "isFlaggedFraud": F.when((kind == "TRANSFER") & (cents > 40000000), 1).otherwise(0),
        "old_o": F.when(fraud & (k % 5 != 0), cents).otherwise(cents * (k % 7)),
        "old_d": F.when(kind == "PAYMENT", F.lit(0).cast("long")).otherwise((k % 9) * 10000000),
    })
    drained = F.greatest(F.col("old_o") - cents, F.lit(0))
    paid_out = F.greatest(F.col("old_d") - cents, F.lit(0))
    new_o = F.when(kind == "CASH_IN", F.col("old_o") + cents).otherwise(drained)
    new_d = (F.when(kind == "PAYMENT", F.lit(0)).when(kind == "CASH_IN", paid_out)
             .otherwise(F.col("old_d") + cents))
    merchant = F.concat(F.lit("M"), ((k * 7) % 97).cast("string"))
    customer = F.concat(F.lit("C"), ((ck * 31 + 7) % 1009).cast("string"))
    return marked.select(
        "id", "step", "type",
        (cents / 100).alias("amount"),
        F.concat(F.lit("C"), ck.cast("string")).alias("nameOrig"),
        (F.col("old_o") / 100).alias("oldbalanceOrg"),
        (new_o / 100).alias("newbalanceOrig"),
        F.when(kind == "PAYMENT", merchant).otherwise(customer).alias("nameDest"),
        (F.col("old_d") / 100).alias("oldbalanceDest"),
        (new_d / 100).alias("newbalanceDest"),
        "isFraud", "isFlaggedFraud",
    )


def with_defects(transactions: DataFrame) -> DataFrame:
    """The raw columns with missing balances, zero amounts and repeated rows, no ``id``."""
    k = F.col("id")
    broken = transactions.withColumns({
        "oldbalanceDest": F.when(k % 125 != 0, F.col("oldbalanceDest")),
        "newbalanceDest": F.when(k % 187 != 0, F.col("newbalanceDest")),
        "amount": F.when(k % 1000 == 3, F.lit(0.0)).otherwise(F.col("amount")),
    })
    copies = F.explode(F.array_repeat(F.lit(1), F.when(k % 3000 == 1, 2).otherwise(1)))
    return broken.select(*C.RAW_COLUMNS, copies.alias("copy")).drop("copy")
