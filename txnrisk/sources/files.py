"""CSV and Parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from txnrisk.functions import constants as C
from txnrisk.sources import schema as S


def _present(name: str) -> Column:
    """The cell's text, or NULL for a missing-value token."""
    text = F.col(name)
    return F.when(~F.trim(text).isin(C.MISSING_TOKENS), text)


def _typed(name: str, kind: T.DataType) -> Column:
    cell = _present(name)
    if isinstance(kind, T.IntegerType):
        # "1.0" is a whole number in a file that once held a missing value; "1.7" does not fit.
        number = cell.try_cast("double")
        return F.coalesce(F.when(number == F.floor(number), number.try_cast("int")), F.when(number.isNull(), cell.try_cast("int")))
    return cell if isinstance(kind, T.StringType) else cell.try_cast(kind)


def scan_text(spark: SparkSession, path: str, schema: T.StructType = S.RAW) -> DataFrame:
    """The declared columns as text, found by header name. Files that disagree on the header raise."""
    text = spark.read.csv(path, header=True, nullValue="", enforceSchema=False)
    return text.select(*schema.names)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = S.RAW) -> DataFrame:
    """CSV scan with declared types.

    Cells are read as text because the built-in reader knows one missing-value
    token only. ``type`` is trimmed and upper-cased. Cells that are neither a
    token nor a number come out NULL; ``malformed_cells`` lists how many.
    """
    text = scan_text(spark, path, schema)
    typed = text.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema])
    if "type" in typed.columns:
        typed = typed.withColumn("type", F.upper(F.trim("type")))
    return typed


def malformed_cells(spark: SparkSession, path: str, schema: T.StructType = S.RAW) -> DataFrame:
    """(column, malformed): cells with text that does not fit the declared type."""
    text = scan_text(spark, path, schema)
    kinds = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    counts = text.agg(*[
        F.count_if(_present(f.name).isNotNull() & _typed(f.name, f.dataType).isNull()).alias(f.name)
        for f in kinds
    ])
    return counts.unpivot([], [f.name for f in kinds], "column", "malformed").where("malformed > 0")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_diagnostics(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows): shape and types of a scan, with one count."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("dtype"))
             for i, f in enumerate(df.schema)]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.inline(F.array(*cells)), "rows")
