"""Scalar column helpers: rounding, division, binning and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rnd(x: Column, digits: int) -> Column:
    """Round half away from zero through an exact decimal, back to double.

    Going through ``decimal(38,10)`` makes 2.675 round to 2.68 and hides the
    last-bit noise of floating sums. The double keeps cents up to 9e13.
    """
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int) -> Column:
    return rnd(ratio(num, den) * F.lit(100.0), digits)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL: a missing value, as in a frame that has no NULLs for numbers."""
    kinds = (T.DoubleType, T.FloatType)
    names = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df


def flag(condition: Column) -> Column:
    """0/1 integer. Flags are summed and multiplied, so they are not booleans."""
    return F.when(condition, 1).otherwise(0)


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str],
                 above: float | None = None) -> Column:
    """Label of the right-closed bin of ``x``; edges are the upper ends.

    The first bin is open below unless ``above`` is given: an exclusive lower bound
    at or under which the label is NULL. Values beyond the last edge get NULL.
    """
    out = None
    for edge, label in zip(edges, labels):
        test = x <= F.lit(edge)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out if above is None else F.when(x > F.lit(above), out)


def position(x: Column, order: Sequence[str]) -> Column:
    """1-based place of ``x`` in a fixed order list, 0 when absent."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), x)


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL (greatest/least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def money_text(x: Column) -> Column:
    """``$1,234.50``; rounded half up first because format_number rounds half even."""
    return F.concat(F.lit("$"), F.format_number(F.round(x.cast("decimal(38,10)"), 2), 2))


def percent_text(x: Column, digits: int) -> Column:
    return F.concat(F.round(x.cast("decimal(38,10)"), digits).cast("string"), F.lit("%"))


def weekend_label(x: Column) -> Column:
    return F.when(x == 1, "Weekend").otherwise("Weekday")
