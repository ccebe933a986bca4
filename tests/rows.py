"""Hand-made transactions."""

from pyspark.sql import types as T

from txnrisk.sources import schema as S

BASE = {
    "step": 1, "type": "PAYMENT", "amount": 100.0, "nameOrig": "C1", "oldbalanceOrg": 500.0,
    "newbalanceOrig": 400.0, "nameDest": "M1", "oldbalanceDest": 0.0, "newbalanceDest": 0.0,
    "isFraud": 0, "isFlaggedFraud": 0,
}


def raw(spark, *changes):
    data = [tuple({**BASE, **c}[f.name] for f in S.RAW) for c in changes]
    return spark.createDataFrame(data, S.RAW)


def raw_with_id(spark, *changes):
    data = [(i, *({**BASE, **c}[f.name] for f in S.RAW)) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, T.StructType([T.StructField("id", T.LongType()), *S.RAW]))
