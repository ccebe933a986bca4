"""Small tables with awkward rows, and a fast way to make them."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple], schema: str = DOCS) -> DataFrame:
    """Rows (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(full, schema)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and long texts, repeated rows, ties and columns with clashing names."""
    rows = [(1, None, None, None), (2, ""), (None, "no id here"), (None, "no id here"), (3, "word " * 9000),
            (4, "same text"), (4, "same text"), (5, "same text"), (4, "other text of the same id"), (6, "   "), (7, None, "en", "s")]
    wide = docs(spark, rows)
    for name in ("length", "piece", "key", "label", "rank", "spans", "_part", "bucket", "size", "shard", "next", "start"):
        wide = wide.withColumn(name, wide["doc_id"])
    return wide


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
