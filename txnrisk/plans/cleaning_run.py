"""Raw transactions to the cleaned table, with a step-by-step account."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk.functions import constants as C
from txnrisk.functions.features import add_features
from txnrisk.functions.scalars import without_nan
from txnrisk.operators import cleaning, quality
from txnrisk.session import stage
from txnrisk.sources import files, schema as S

@dataclass(frozen=True)
class Learned:
    """Values taken from the data, for every column: enough to clean new rows the same way,
    also where they have gaps that the data did not have."""

    fills: Mapping[str, object]
    cap: float | None


@dataclass(frozen=True)
class Prepared:
    """Filled, de-duplicated rows stored in the shared folder, with what was learned and counted on the way.

    ``fills`` are those that this run needs. ``learned`` has a fill for every column and
    passes over the raw rows for the others when it is first asked for.
    """

    raw: DataFrame
    distinct: DataFrame
    fills: Mapping[str, object]
    cap: float | None
    missing: Mapping[str, int]
    raw_rows: int
    capped: int

    @cached_property
    def rows(self) -> Mapping[str, int]:
        """Rows after each step: one pass over two stored columns, the rest is known."""
        positive = F.col("amount") > 0
        counted = self.distinct.agg(
            F.count(F.lit(1)).alias("distinct"),
            F.count_if(positive).alias("valid"),
            F.count_if(positive & (F.col("amount") > C.EXTREME_AMOUNT)).alias("extreme"),
            F.count_if(positive & F.col("type").isin(list(C.TYPE_CODES))).alias("encoded"),
        ).first()
        return {"raw": self.raw_rows, "capped": self.capped, **counted.asDict()}

    @property
    def valid(self) -> DataFrame:
        return cleaning.drop_invalid_amounts(self.distinct)

    @cached_property
    def learned(self) -> Learned:
        others = [c for c in self.raw.columns if c not in self.fills]
        return Learned({**self.fills, **cleaning.fill_values(cleaning.fill_zero_balances(self.raw), wanted=others)}, self.cap)


@dataclass(frozen=True)
class Cleaned:
    """Outcome of a file-to-file run."""

    table: DataFrame
    audit: DataFrame
    steps: DataFrame
    checks: DataFrame


def distinct_rows(raw: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Fill, then drop exact copies: rows may become equal only by filling."""
    filled = cleaning.fill_missing(cleaning.fill_zero_balances(raw), fills)
    return cleaning.drop_duplicates(filled)


def valid_rows(raw: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return cleaning.drop_invalid_amounts(distinct_rows(raw, fills))


def learn_fills(raw: DataFrame) -> dict[str, object]:
    return cleaning.fill_values(cleaning.fill_zero_balances(raw))


def prepare(raw: DataFrame) -> Prepared:
    """De-duplication shuffles whole rows and several passes follow, so its result is
    written once to the shared folder. The cap is learned from its valid rows.
    """
    rows, missing = cleaning.missing_counts(without_nan(raw))
    open_columns = [c for c, n in missing.items() if n and c not in C.ZERO_FILL_COLUMNS]
    fills = cleaning.fill_values(cleaning.fill_zero_balances(raw), wanted=open_columns)
    distinct = stage(distinct_rows(raw, fills), "distinct-rows")
    cap, capped = cleaning.cap_value(cleaning.drop_invalid_amounts(distinct))
    return Prepared(raw, distinct, fills, cap, missing, rows, capped)


def needed(raw: DataFrame, fills: Mapping[str, object]) -> dict[str, object]:
    """The fills of columns with gaps: a fractional median would change the type of the others."""
    return {c: fills[c] for c in cleaning.gaps(cleaning.fill_zero_balances(raw)) if c in fills}


def finish(valid: DataFrame, cap: float | None, strict: bool = False) -> DataFrame:
    """Cap, derive and encode: per-row steps only, fit for streams."""
    capped = cleaning.cap_amounts(valid, cap)
    return cleaning.encode_types(add_features(capped), strict)


def clean(raw: DataFrame, learned: Learned | None = None, strict: bool = False) -> DataFrame:
    """The 25-column cleaned table. Unknown types are left out unless ``strict`` raises."""
    if learned is None:
        return clean_prepared(prepare(raw), strict)
    return finish(valid_rows(raw, needed(raw, learned.fills)), learned.cap, strict).select(*S.CLEANED.names)


def clean_prepared(prepared: Prepared, strict: bool = False) -> DataFrame:
    return finish(prepared.valid, prepared.cap, strict).select(*S.CLEANED.names)


def step_audit(raw: DataFrame, prepared: Prepared | None = None) -> DataFrame:
    """(step, rows_in, rows_out, detail) of a cleaning run.

    The raw rows were counted when gaps were looked for, and rows above the cap when it was found. (Counts taken by
    the write itself need ``Observation``, after which this version's models can no longer be applied in the session.)
    """
    prepared = prepared or prepare(raw)
    n, cap = prepared.rows, prepared.cap
    steps = []
    for name in (c for c, gone in prepared.missing.items() if c in C.ZERO_FILL_COLUMNS or gone and c in prepared.fills):
        value = 0.0 if name in C.ZERO_FILL_COLUMNS else prepared.fills[name]
        steps.append((f"fill {name}", n["raw"], n["raw"], f"{prepared.missing[name]} missing filled with {value}"))
    steps += [
        ("drop duplicates", n["raw"], n["distinct"], f"{n['raw'] - n['distinct']} removed"),
        ("drop invalid amounts", n["distinct"], n["valid"], f"{n['distinct'] - n['valid']} removed"),
        ("cap amounts", n["valid"], n["valid"],
         f"cap {0.0 if cap is None else cap:.2f}, {n['capped']} capped, {n['extreme']} extreme"),
        ("encode types", n["valid"], n["encoded"], f"{n['valid'] - n['encoded']} unknown"),
    ]
    return raw.sparkSession.createDataFrame(
        steps, "step string, rows_in long, rows_out long, detail string")


def run(spark: SparkSession, raw_path: str, clean_path: str, as_csv: bool = False,
        strict: bool = True) -> Cleaned:
    """CSV file in, cleaned table out, validated on what was written and read back.

    Strict mode raises on an unknown type or a failed check.
    """
    raw = without_nan(files.read_csv(spark, raw_path))
    audit = quality.audit(raw)
    prepared = prepare(raw)
    cleaned = clean_prepared(prepared, strict)
    if as_csv:
        files.write_csv(cleaned, clean_path)
        stored = files.read_csv(spark, clean_path, cleaned.schema)
    else:
        files.write_parquet(cleaned, clean_path)
        stored = spark.read.parquet(clean_path)
    # The other columns follow from the raw ones, so copies show in these alone.
    checks = quality.validate(stored, strict=strict, key=C.RAW_COLUMNS)
    return Cleaned(stored, audit, step_audit(raw, prepared), checks)
