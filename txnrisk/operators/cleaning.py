"""Cleaning steps. Values learned from the data are passed in, so every step is a pure function."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from txnrisk.functions import constants as C
from txnrisk.functions.features import is_extreme_amount, type_code
from txnrisk.functions.scalars import without_nan
from txnrisk.operators.quantiles import exact_quantiles, most_common_each, quantile_and_above


def fill_zero_balances(df: DataFrame) -> DataFrame:
    """Missing destination balances mean a new account: 0. NaN counts as missing, here and after."""
    return without_nan(df).na.fill(0.0, subset=C.ZERO_FILL_COLUMNS)


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and missing cells per column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return counts["_rows"], {c: counts[c] for c in df.columns}


def gaps(df: DataFrame) -> list[str]:
    """Columns with missing cells."""
    return [c for c, n in missing_counts(df)[1].items() if n > 0]


def fill_values(df: DataFrame, every: bool = False, wanted: Sequence[str] | None = None) -> dict[str, object]:
    """Value per column that still has missing cells: the median, or the mode of text.

    Looks at the frame after ``fill_zero_balances``. A column without any value is left out.
    ``every`` takes complete columns too, for rows to come that have other gaps; ``wanted`` names the columns.
    """
    if wanted is None:
        wanted = df.columns if every else gaps(df)
    fields = [f for f in df.schema if f.name in wanted]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    values: dict[str, object] = {}
    if numeric:
        medians = exact_quantiles(df, {c: F.col(c) for c in numeric}, [0.5])
        values.update({c: m[0] for c, m in medians.items() if m[0] is not None})
    return values | most_common_each(df, [f.name for f in fields if isinstance(f.dataType, T.StringType)])


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill by column. A whole-number column takes a fractional median as double."""
    filled = {}
    for name, value in values.items():
        kind = df.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, T.IntegralType):
            if float(value).is_integer():
                value = int(value)
            else:
                column = column.cast("double")
        filled[name] = F.coalesce(column, F.lit(value))
    return df.withColumns(filled) if filled else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_invalid_amounts(df: DataFrame) -> DataFrame:
    return df.where((F.col("amount") > 0) & ~F.isnan("amount"))


def cap_value(df: DataFrame, q: float = C.CAP_QUANTILE) -> tuple[float | None, int]:
    """The exact interpolated quantile of ``amount``, and the number of amounts above it."""
    return quantile_and_above(df, "amount", q)


def cap_amounts(df: DataFrame, cap: float | None) -> DataFrame:
    """``amount_capped`` beside the untouched amount, and the extreme flag."""
    amount = F.col("amount")
    capped = amount if cap is None else F.when(amount.isNotNull(), F.least(amount, F.lit(cap)))
    return df.withColumns({"amount_capped": capped, "is_extreme_amount": is_extreme_amount()})


def encode_types(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``type_encoded``. Unknown types raise in strict mode, else leave for ``unknown_types``."""
    if strict:
        known = type_code()
        code = F.when(known.isNotNull(), known).otherwise(
            F.raise_error(F.concat(F.lit("unknown transaction type: "),
                                   F.coalesce(F.col("type"), F.lit("NULL")))).cast("int"))
        return df.withColumn("type_encoded", code)
    coded = df.withColumn("type_encoded", type_code())
    return coded.where(F.col("type_encoded").isNotNull())


def unknown_types(df: DataFrame) -> DataFrame:
    """The rows ``encode_types`` turns away."""
    return df.where(type_code().isNull())
