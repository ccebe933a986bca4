"""Ranks, running counts and previous-row lookups that never gather an unbounded group.

A window without PARTITION BY, or one partitioned by a key that holds a third of the
rows, sorts everything in one task. Here the order column is cut into value ranges by
fixed boundaries, a bounded list of numbers. Ranges are sorted side by side and joined
up with the sums of the ranges before. Boundaries are literals, so a row's range depends
on its value alone, whatever the partitioning, and any boundaries give the right result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.session import stage

# A group up to this many rows is fine for one task; the sort spills.
GROUP_ROWS = 4_000_000
MAX_RANGES = 16384
# Rows looked at per range to place the boundaries.
SAMPLE_PER_RANGE = 100


def range_count(rows: int, partitions: int) -> int:
    """Ranges for so many rows: about GROUP_ROWS in each, and one for every shuffle partition at least.

    From MAX_RANGES on, which keeps the boundaries a bounded list, ranges hold more rows.
    """
    return max(16, min(max(partitions, -(-rows // GROUP_ROWS)), MAX_RANGES))


def range_marks(df: DataFrame, column: str, ranges: int | None = None,
                strict: bool = False) -> tuple[int, list[float]]:
    """(non-null rows, increasing boundaries) with about equal rows between boundaries.

    ``column`` is numeric; strict mode refuses NULLs in it. Boundaries come from a sample of
    bounded size, as in a range repartitioning: they decide only how even the ranges are.
    Every row takes part in the counts that follow.
    """
    total, rows = df.agg(F.count(column), F.count(F.lit(1))).first()
    if strict and rows != total:
        raise ValueError(f"{column} is missing in {rows - total} rows; fill it before ranking")
    ranges = ranges or range_count(total, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    wanted = SAMPLE_PER_RANGE * ranges
    looked = df if total <= wanted else df.sample(wanted / total, seed=1)
    points = [i / ranges for i in range(1, ranges)]
    marks = looked.agg(
        F.percentile_approx(F.col(column).cast("double"), points, 20 * ranges)).first()[0]
    return total, sorted(set(marks or []))


def with_range(df: DataFrame, column: str, marks: Sequence[float], out: str) -> DataFrame:
    """Add the range number of ``column``; it never falls as the value grows."""
    if not marks:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *marks, float("inf")], inputCol="_v", outputCol="_r")
    cast = df.withColumn("_v", F.col(column).cast("double"))
    # Never NULL, so that no "is not null" check on it is pushed down to the raw rows.
    number = F.coalesce(F.col("_r").cast("int"), F.lit(0))
    return cut.transform(cast).withColumn(out, number).drop("_v", "_r")


def running_totals(df: DataFrame, column: str, measures: Mapping[str, Column],
                   ascending: bool = True, marks: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct value of ``column`` with each measure, its sum over all
    values before (``<m>_before``) and over all values (``<m>_total``).

    Measures are additive aggregates such as counts. NULL values are left out.
    """
    present = df.where(F.col(column).isNotNull())
    if marks is None:
        _, marks = range_marks(present, column)
    per_value = present.groupBy(column).agg(*[m.alias(name) for name, m in measures.items()])
    ranged = with_range(per_value, column, marks, "_range")

    sums = ranged.groupBy("_range").agg(*[F.sum(m).alias(m) for m in measures])
    direction = F.asc if ascending else F.desc
    before = Window.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(direction("_range")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = (Window.partitionBy("_range").orderBy(direction(column))
              .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumns({
        f"_{m}_local": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures
    })
    # The broadcast side has one row per range, MAX_RANGES at the most.
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.select(
        column, *measures,
        *[(F.col(f"_{m}_offset") + F.col(f"_{m}_local")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def ntile(row_number: Column, total: Column, tiles: int) -> Column:
    """Tile of a row number: sizes differ by one at most, larger tiles first."""
    small = F.floor(total / tiles)
    large_rows = (total % tiles) * (small + 1)
    first = F.floor((row_number - 1) / (small + 1)) + 1
    rest = (total % tiles) + F.floor(F.try_divide(row_number - 1 - large_rows, small)) + 1
    return F.when(row_number <= large_rows, first).otherwise(rest).cast("int")


def global_rank(df: DataFrame, column: str, ascending: bool = True, tie: str = "id",
                tiles: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` plus rank, dense_rank, row_number, ntile, percent_rank and cume_dist over all rows.

    Equal values share rank; ``tie`` (unique) orders them for row_number. A value with
    more rows than ``group_rows`` is cut by ranges of ``tie`` so its rows spread out.
    Both columns are numeric; NULLs in ``column`` are refused.
    """
    total, marks = range_marks(df, column, strict=True)
    per_value = running_totals(df, column, {"n": F.count(F.lit(1)), "d": F.max(F.lit(1))},
                               ascending, marks)
    heavy = heavy_keys(df, column, group_rows, total)
    if heavy is None:
        rows = df.withColumn("_cell", F.lit(0))
        per_cell = per_value.withColumns({"_cell": F.lit(0), "_shift": F.lit(0)})
    else:
        marked = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
        ranged = with_range(df, tie, range_marks(df, tie)[1], "_tie_range").join(marked, column, "left")
        rows = ranged.withColumn("_cell", F.when(F.col("_heavy"), F.col("_tie_range")).otherwise(0))
        cells = rows.where("_heavy").groupBy(column, "_cell").agg(F.count(F.lit(1)).alias("_c"))
        earlier = (Window.partitionBy(column).orderBy("_cell")
                   .rowsBetween(Window.unboundedPreceding, -1))
        shifted = cells.select(column, F.col("_cell").alias("_of"), F.sum("_c").over(earlier).alias("_by"))
        per_cell = per_value.join(shifted, column, "left").withColumns({
            "_cell": F.coalesce("_of", F.lit(0)), "_shift": F.coalesce("_by", F.lit(0))})
    inside = Window.partitionBy(column, "_cell").orderBy(tie)
    joined = rows.join(per_cell, [column, "_cell"]).withColumn("_pos", F.row_number().over(inside))
    number = F.col("n_before") + F.col("_shift") + F.col("_pos")
    n = F.col("n_total")
    return joined.select(
        *df.columns,
        (F.col("n_before") + 1).alias("rank"),
        (F.col("d_before") + 1).alias("dense_rank"),
        number.alias("row_number"),
        ntile(number, n, tiles).alias("ntile"),
        F.coalesce(F.try_divide(F.col("n_before").cast("double"), n - 1), F.lit(0.0)).alias("percent_rank"),
        ((F.col("n_before") + F.col("n")) / n).alias("cume_dist"),
    )


def heavy_keys(df: DataFrame, key: str, group_rows: int = GROUP_ROWS,
               total: int | None = None) -> DataFrame | None:
    """Keys with more than ``group_rows`` rows, None when there are none.

    At most rows / group_rows keys qualify, so the result is safe to broadcast. It is
    stored, so that the counting is done once.
    """
    if (df.count() if total is None else total) <= group_rows:
        return None
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heavy = stage(counts.where(F.col("_n") > group_rows).select(key), "heavy-keys")
    return None if heavy.isEmpty() else heavy


def with_neighbour(df: DataFrame, key: str, order: str, columns: Sequence[str], tie: str = "id",
                   following: bool = False, only: DataFrame | None = None,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``prev_<c>`` (or ``next_<c>``): the values of the neighbouring row of the same key.

    Rows are ordered by (order, tie), both numeric or times. ``only`` keeps the keys of a
    one-column frame. Keys of ordinary size use one window. A heavy key is cut into cells by
    ranges of ``order``. A value that a range starts with may hold any number of rows, as may
    a missing one, so these are cut by ranges of ``tie``. Rows look inside their cell, and a
    cell's edge row takes the edge of the neighbouring cell.
    """
    prefix = "next" if following else "prev"
    step_to = F.lead if following else F.lag

    def plain(part: DataFrame) -> DataFrame:
        kept = part if only is None else part.join(only, key, "left_semi")
        w = Window.partitionBy(key).orderBy(order, tie)
        return kept.withColumns({f"{prefix}_{c}": step_to(c).over(w) for c in columns})

    counted = df.select(key)
    heavy = heavy_keys(counted if only is None else counted.join(only, key, "left_semi"), key, group_rows)
    if heavy is None:
        return plain(df)

    # Heavy keys leave before any shuffle by key.
    def of(keys: DataFrame) -> tuple[DataFrame, Column]:
        """For joins that match missing keys too."""
        return F.broadcast(keys.select(F.col(key).alias("_heavy"))), F.col(key).eqNullSafe(F.col("_heavy"))

    light = plain(df.join(*of(heavy), "left_anti"))
    dense = df.join(*of(heavy), "left_semi")
    _, starts = range_marks(dense, order)
    _, marks = range_marks(dense, tie)
    ranged = with_range(with_range(dense, order, starts, "_range"), tie, marks, "_tie_range")
    missing = F.col(order).isNull()
    at_start = missing | F.coalesce(F.col(order).cast("double").isin(starts), F.lit(False))
    rows = ranged.withColumns({
        "_range": F.when(missing, -1).otherwise(F.col("_range")),
        "_inner": F.when(at_start, 0).otherwise(1),
        "_value": F.when(at_start, F.col(order)),
        "_cell": F.when(at_start, F.col("_tie_range")).otherwise(0),
    })
    place = ["_range", "_inner", "_value", "_cell"]
    packed, at = F.struct(*columns), F.struct(order, tie)
    edge = F.min_by(packed, at) if following else F.max_by(packed, at)
    cells = rows.groupBy(key, *place).agg(edge.alias("_edge"))
    edges = cells.withColumn("_edge", step_to("_edge").over(Window.partitionBy(key).orderBy(*place)))
    inside = Window.partitionBy(key, *place).orderBy(order, tie)
    looked = rows.withColumn("_near", step_to(packed).over(inside))
    own = edges.select(F.col(key).alias("_k"), *[F.col(c).alias(f"{c}_of") for c in place], "_edge")
    same_cell = F.col(key).eqNullSafe(F.col("_k"))
    for c in place:
        same_cell = same_cell & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    joined = looked.join(own, same_cell)
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    return light.unionByName(joined.select(*df.columns, *[near[c].alias(f"{prefix}_{c}") for c in columns]))
