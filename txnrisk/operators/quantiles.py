"""Exact interpolated quantiles, medians and modes without sorting or gathering the data.

The built-in exact ``percentile`` keeps every distinct value of a group in one task's
memory. Here each wanted order statistic is first bracketed by ``percentile_approx``,
the bracket is verified by counting, and then narrowed by counting rows per bin inside
it until one value is left. Each pass is one scan with a small map-side aggregate;
the driver sees at most ``bins`` counts per wanted quantile and pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A wide bracket costs no more than one extra narrowing pass, so sketches stay small.
ACCURACY = 500
BINS = 2048
# Sketches are merged in two levels: each of so many groups merges those of its share of the tasks
# and passes on GRID + 1 values. A million tasks make groups of a thousand sketches.
SKETCH_GROUPS = 1024
GRID = 200


class _Target:
    """Bracket of the order statistics ``low`` and ``high`` of one stream."""

    def __init__(self, stream: str, position: float):
        self.stream = stream
        self.position = position
        self.low = math.floor(position)
        self.high = math.ceil(position)
        self.start = self.stop = None
        self.below = self.inside = 0
        self.low_value = self.high_value = None
        self.rows = 0

    @property
    def done(self) -> bool:
        return self.low_value is not None and self.high_value is not None

    @property
    def above(self) -> int:
        """Rows above ``value``, of the ``rows`` there are."""
        return self.rows - (self.high if self.low_value < self.high_value else self.below + self.inside)

    @property
    def value(self) -> float:
        share = self.position - self.low
        return self.low_value * (1 - share) + self.high_value * share

    def bracket(self, start, stop, below, inside):
        self.start, self.stop, self.below, self.inside = start, stop, below, inside
        if start == stop:
            self.low_value = self.high_value = start

    def narrow(self, bins):
        """``bins``: (count, smallest, largest) in value order, covering the bracket."""
        seen = self.below
        hit_low = hit_high = None
        for count, smallest, largest in bins:
            if hit_low is None and self.low < seen + count:
                hit_low = (seen, count, smallest, largest)
            if self.high < seen + count:
                hit_high = (seen, count, smallest, largest)
                break
            seen += count
        if hit_low == hit_high:
            below, count, smallest, largest = hit_low
            self.bracket(smallest, largest, below, count)
        else:  # neighbours across a bin edge
            self.low_value, self.high_value = hit_low[3], hit_high[2]


def exact_quantiles(df: DataFrame, streams: Mapping[str, Column], probs: Sequence[float],
                    accuracy: int = ACCURACY, bins: int = BINS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each stream; NULLs are skipped, None when empty.

    A stream is any numeric column expression, so ``when(cond, x)`` gives a group's quantiles.
    """
    asks = [(name, q, None) for name in streams for q in probs]
    found = iter(_values(_solve(df, streams, asks, accuracy, bins)))
    return {name: [next(found) for _ in probs] for name in streams}


def quantile_and_above(df: DataFrame, column: str, q: float) -> tuple[float | None, int]:
    """The quantile of a column and the number of rows above it, which the search has counted anyway."""
    target, = _solve(df, {column: F.col(column)}, [(column, q, None)], ACCURACY, BINS)
    return (target.value, target.above) if target else (None, 0)


def kth_smallest(df: DataFrame, streams: Mapping[str, Column], ranks: Mapping[str, tuple[int, int]],
                 accuracy: int = ACCURACY, bins: int = BINS) -> dict[str, float | None]:
    """The k-th smallest value of each stream; ``ranks`` gives (k, rows of the stream)."""
    asks = [(name, (k - 1) / max(n - 1, 1), float(k - 1)) for name, (k, n) in ranks.items()]
    return dict(zip(ranks, _values(_solve(df, streams, asks, accuracy, bins))))


def _values(targets: Sequence[_Target | None]) -> list[float | None]:
    return [t.value if t else None for t in targets]


def _solve(df, streams, asks, accuracy, bins) -> list[_Target | None]:
    """Settled targets for (stream, probability, position or None) in the order asked; None for an empty stream."""
    values = {name: expr.cast("double") for name, expr in streams.items()}
    margin = 2.0 / accuracy + 1.0 / GRID
    points = {name: [] for name in values}
    for name, q, _ in asks:
        points[name] += [max(0.0, q - margin), min(1.0, q + margin)]
    seen = _first_look(df, values, points, accuracy)
    used = dict.fromkeys(values, 0)
    targets = []
    for name, q, position in asks:
        n, marks, at = seen[name]["n"], seen[name]["marks"], used[name]
        used[name] += 2
        if not n:
            targets.append(None)
            continue
        target = _Target(name, (n - 1) * q if position is None else position)
        target.start, target.stop, target.rows = marks[at], marks[at + 1], n
        targets.append(target)
    live = [t for t in targets if t]
    if live:
        _check_brackets(df, values, seen, live)
    while open_targets := [t for t in live if not t.done]:
        _narrow_all(df, values, open_targets, bins)
    return targets


def _first_look(df, values, points, accuracy) -> dict:
    """n, lo, hi and the approximate quantiles ``marks`` of each stream."""
    names = list(values)
    held = df.select(*[v.alias(f"s{i}") for i, v in enumerate(values.values())],
                     F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group"))
    grid = [k / GRID for k in range(GRID + 1)]
    parts = held.groupBy("_group").agg(*[
        F.struct(F.lit(i).alias("i"), F.count(f"s{i}").alias("n"), F.min(f"s{i}").alias("lo"), F.max(f"s{i}").alias("hi"),
                 F.percentile_approx(f"s{i}", grid, accuracy).alias("marks")).alias(f"p{i}") for i in range(len(names))])
    each = parts.select(F.explode(F.array(*[f"p{i}" for i in range(len(names))])).alias("p")).where(F.col("p.n") > 0)
    marked = each.select("p.i", "p.n", "p.lo", "p.hi", F.posexplode("p.marks").alias("at", "mark"))
    wanted = sorted({q for qs in points.values() for q in qs})
    # a group's marks stand for equal shares of its rows; there are SKETCH_GROUPS x (GRID + 1) of them at the most
    looked = {r["i"]: r for r in marked.groupBy("i").agg(
        F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.percentile("mark", wanted, F.col("n")).alias("marks")).collect()}
    out = {}
    for i, name in enumerate(names):
        r = looked.get(i)
        marks = dict(zip(wanted, r["marks"])) if r else {}
        out[name] = {"n": r["n"] if r else 0, "lo": r["lo"] if r else None, "hi": r["hi"] if r else None,
                     "marks": [marks.get(q) for q in points[name]]}
    return out


def _check_brackets(df, values, seen, targets):
    """Count what lies below and inside each guess; a guess that misses becomes the whole range."""
    checks = []
    for i, t in enumerate(targets):
        v = values[t.stream]
        checks += [F.count_if(v < t.start).alias(f"b{i}"), F.count_if(v <= t.stop).alias(f"u{i}")]
    counted = df.agg(*checks).first()
    for i, t in enumerate(targets):
        below, upto = counted[f"b{i}"], counted[f"u{i}"]
        if below <= t.low and t.high < upto:
            t.bracket(t.start, t.stop, below, upto - below)
        else:
            whole = seen[t.stream]
            t.bracket(whole["lo"], whole["hi"], 0, whole["n"])


def _narrow_all(df, values, targets, bins):
    entries, inside_any = [], F.lit(False)
    for i, t in enumerate(targets):
        v = values[t.stream]
        inside = v.between(t.start, t.stop)
        inside_any = inside_any | inside
        if t.inside <= bins:
            bin_of = v
        else:
            bin_of = F.floor((v - t.start) / (t.stop - t.start) * (bins - 1)).cast("double")
        entries.append(F.when(inside, F.struct(F.lit(i).alias("t"), bin_of.alias("bin"), v.alias("v"))))
    hits = df.where(inside_any).select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    counts = (
        hits.groupBy("e.t", "e.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        .collect()
    )
    for i, t in enumerate(targets):
        own = sorted((r for r in counts if r["t"] == i), key=lambda r: r["bin"])
        t.narrow([(r["n"], r["lo"], r["hi"]) for r in own])


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, {column: F.col(column)}, [0.5])[column][0]


def most_common_each(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each text column that has one, the smallest among equals, in one pass."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])).alias("x")
    counts = (df.select(cells).where(F.col("x.value").isNotNull()).groupBy("x.name", "x.value").agg(F.count(F.lit(1)).alias("n")))
    tops = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return {r["name"]: r["value"] for r in tops.collect()}


def most_common(df: DataFrame, column: str) -> str | None:
    """The most frequent value, the smallest among equals; None when all are NULL."""
    return most_common_each(df, [column]).get(column)
