"""Exact order statistics of any number of groups at once.

The built-in exact ``percentile`` keeps every distinct value of a group in one task, and one
column per group means a pass for every few dozen groups. Here the bracket of each wanted order
statistic is a row of a table. A pass joins rows to the brackets of their group, counts them per bin
inside, and narrows all brackets of all groups together, so the number of passes depends on the
values and not on how many groups there are. Nothing about groups reaches the driver, and no task
sees more of a group than its share of the rows and ``BINS`` counts a bracket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from txnrisk.session import stage

BINS = 2048


def grouped_values(df: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, v): the rows that have a group and a value, stored, for the passes over them."""
    rows = df.select(F.col(by), value.cast("double").alias("v"))
    return stage(rows.where(F.col(by).isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")), "grouped-values")


def _narrowed(values: DataFrame, brackets: DataFrame, by: str, bins: int) -> DataFrame:
    """``brackets`` after one pass: ``low_value`` and ``high_value`` are set where they are known."""
    v, start, stop = F.col("v"), F.col("start"), F.col("stop")
    share = (v / 2 - start / 2) / (stop / 2 - start / 2)  # halves: the distance itself may overflow
    bin_of = F.when(F.col("inside") <= bins, v).otherwise(F.floor(share * (bins - 1)).cast("double"))
    counts = (values.join(brackets.select(by, "t", "start", "stop", "inside"), by).where(v.between(start, stop))
              .groupBy(by, "t", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b")))
    before = Window.partitionBy(by, "t").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    seen = counts.withColumn("seen", F.coalesce(F.sum("c").over(before), F.lit(0)))
    met = brackets.join(seen, [by, "t"]).withColumn("seen", F.col("below") + F.col("seen"))
    cell = F.struct("seen", "c", "a", "b")

    def holding(rank: str) -> Column:
        return F.max(F.when((F.col("seen") <= F.col(rank)) & (F.col(rank) < F.col("seen") + F.col("c")), cell))

    fixed = ("low", "high", "share")
    hit = met.groupBy(by, "t").agg(*[F.first(c).alias(c) for c in fixed], holding("low").alias("l"), holding("high").alias("h"))
    same = F.col("l.seen") == F.col("h.seen")
    known = ~same | (F.col("l.a") == F.col("l.b"))
    return hit.select(
        by, "t", *fixed, F.col("l.a").alias("start"), F.col("l.b").alias("stop"), F.col("l.seen").alias("below"), F.col("l.c").alias("inside"),
        F.when(known, F.col("l.b")).alias("low_value"), F.when(known, F.when(same, F.col("l.b")).otherwise(F.col("h.a"))).alias("high_value"))


def order_statistics(values: DataFrame, by: str, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(by, t, value) of ``wanted`` (by, t, low, high, share): between the ranks ``low`` and ``high``, counted from 0.

    ``values`` (by, v) comes from ``grouped_values`` or is stored otherwise; it is read once a pass.
    """
    spans = values.groupBy(by).agg(F.min("v").alias("start"), F.max("v").alias("stop"), F.count(F.lit(1)).alias("inside"))
    even = F.col("start") == F.col("stop")
    brackets = stage(wanted.join(spans, by).select(
        by, "t", "low", "high", "share", "start", "stop", F.lit(0).cast("long").alias("below"), "inside",
        F.when(even, F.col("start")).alias("low_value"), F.when(even, F.col("start")).alias("high_value")), "brackets")
    done = [brackets.where("low_value is not null")]
    left = brackets.where("low_value is null")
    while not left.isEmpty():
        now = stage(_narrowed(values, left, by, bins), "brackets")
        done.append(now.where("low_value is not null"))
        left = now.where("low_value is null")
    found = reduce(DataFrame.unionByName, done)
    return found.select(by, "t", (F.col("low_value") * (1 - F.col("share")) + F.col("high_value") * F.col("share")).alias("value"))


def grouped_quantiles(values: DataFrame, by: str, probs: Sequence[float], bins: int = BINS) -> DataFrame:
    """(by, n, q): the number of values of each group and its linearly interpolated quantiles, an array."""
    sizes = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.select(by, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("t", "p"))
    at = (F.col("n") - 1) * F.col("p")
    wanted = asked.select(by, "t", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("share"))
    found = order_statistics(values, by, wanted, bins)
    packed = found.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("q"))  # one entry per prob
    return sizes.join(packed.select(by, F.transform("q", lambda x: x["value"]).alias("q")), by)
