"""Chart-ready profiling tables over the feature frame (raw column names)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.functions.scalars import percent, ratio, rnd
from txnrisk.operators.grouped import grouped_quantiles, grouped_values
from txnrisk.operators.quantiles import exact_quantiles
from txnrisk.session import stage

# Wide enough for capped amounts, which need not be whole cents.
MONEY = "decimal(28,8)"


def _fraud() -> Column:
    return F.col("isFraud") == 1


def _rate(digits: int = 4) -> Column:
    return percent(F.sum("isFraud"), F.count("isFraud"), digits)


def over_domain(df: DataFrame, key: str, domain: Sequence, fill: dict[str, object]) -> DataFrame:
    """One row per value of a short fixed list, in its order, filled where ``df`` has none.

    ``df`` has one row per key. Its rows for the list are packed into one map, no larger
    than the list. A join would do too, but pushes "key is not null" down to the raw
    rows, where a derived key is worked out a second time.
    """
    others = [c for c in df.columns if c != key]
    entry = F.when(F.col(key).isin(list(domain)), F.struct(key, F.struct(*others)))
    packed = df.agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    listed = F.array(*[F.lit(v) for v in domain]).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    rows = packed.select("_found", F.explode(listed).alias(key))
    hit = F.try_element_at("_found", F.col(key))
    return rows.select(*[F.col(c) if c == key else hit[c].alias(c) for c in df.columns]).na.fill(fill)


def describe(df: DataFrame, columns: Sequence[str] = tuple(C.DESCRIBED_COLUMNS)) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max), two decimals, exact percentiles."""
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    stats = df.agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
        for c in columns
    ])
    rows = []
    for c in columns:
        low, mid, high = [F.lit(q).cast("double") for q in quartiles[c]]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(c)["n"].alias("count"),
            rnd(F.col(c)["mean"], 2).alias("mean"), rnd(F.col(c)["std"], 2).alias("std"),
            rnd(F.col(c)["lo"], 2).alias("min"), rnd(low, 2).alias("p25"),
            rnd(mid, 2).alias("p50"), rnd(high, 2).alias("p75"), rnd(F.col(c)["hi"], 2).alias("max"),
        ))
    return stats.select(F.inline(F.array(*rows)))


def _counts(df: DataFrame, key: str) -> DataFrame:
    # count(key) is 0 for the NULL group: dropping it here costs no check per raw row.
    counts = df.groupBy(key).agg(F.count(key).alias("count")).where(F.col("count") > 0)
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(key, "count", percent(F.col("count"), total, 4).alias("pct"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, count, pct) with the share of all rows that have a value, in key order."""
    return _counts(df, key).orderBy(key)


def class_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df, "isFraud")


def day_counts(df: DataFrame) -> DataFrame:
    """Rows per weekday over all seven, labelled."""
    counts = df.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.lit(d) for d in C.DAY_NAMES])
    dense = over_domain(counts, "day_of_week", list(range(7)), {"count": 0})
    return dense.withColumn("day_name", F.element_at(names, F.col("day_of_week") + 1))


def tier_counts(df: DataFrame) -> DataFrame:
    counts = _counts(df, "risk_tier")
    return over_domain(counts, "risk_tier", C.RISK_TIERS, {"count": 0, "pct": 0.0})


def histogram(df: DataFrame, value: Column, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over each group's own range, empty bins included, last bin closed.

    (by, bin, bin_start, bin_end, count, density); density has area 1 per group. Ranges are a table joined
    by group, so groups may be any number.
    """
    group = by or "_g"
    data = grouped_values(df if by else df.select("*", F.lit(0).alias("_g")), group, value)
    x, lo, width = F.col("v"), F.col("lo"), F.col("width")
    spans = data.groupBy(group).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    flat = F.col("_lo") == F.col("_hi")
    ranges = stage(spans.select(
        group, "n", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins).alias("width")), "ranges")
    counts = (data.join(ranges, group)
              .groupBy(group, F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("long").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    dense = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    placed = dense.join(counts, [group, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    out = placed.select(
        group, "bin",
        rnd(lo + F.col("bin") * width, 6).alias("bin_start"),
        rnd(lo + (F.col("bin") + 1) * width, 6).alias("bin_end"),
        "count",
        rnd(ratio(F.col("count"), F.col("n") * width), 8).alias("density"),
    ).orderBy(group, "bin")
    return out if by else out.drop("_g")


def amount_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, F.log1p("amount"), 50).drop("density")


def score_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, F.col("risk_score"), 30).drop("density")


def class_amount_density(df: DataFrame) -> DataFrame:
    return histogram(df, F.log1p("amount"), 40, by="isFraud")


def reference_markers(df: DataFrame) -> DataFrame:
    """Median amount (plain and log) and mean risk score: the lines drawn on the histograms."""
    median = exact_quantiles(df, {"amount": F.col("amount")}, [0.5])["amount"][0]
    line = F.lit(median).cast("double")
    return df.agg(F.avg("risk_score").alias("m")).select(
        rnd(line, 2).alias("median_amount"), rnd(F.log1p(line), 6).alias("log_median_amount"),
        rnd(F.col("m"), 4).alias("mean_risk_score"))


def _rates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("isFraud").cast("long").alias("fraud_count"),
        _rate().alias("fraud_rate_pct"),
    )


def fraud_rate_by(df: DataFrame, key: str) -> DataFrame:
    """(key, transactions, fraud_count, fraud_rate_pct) in key order."""
    return _rates(df, key).orderBy(key)


def tier_fraud_rate(df: DataFrame) -> DataFrame:
    empty = {"transactions": 0, "fraud_count": 0, "fraud_rate_pct": 0.0}
    return over_domain(_rates(df, "risk_tier"), "risk_tier", C.RISK_TIERS, empty)


def lift_by(df: DataFrame, key: str) -> DataFrame:
    """Fraud rate of each group over the overall rate."""
    groups = df.groupBy(key).agg(F.count("isFraud").alias("n"), F.sum("isFraud").cast("long").alias("f"))
    base = groups.agg(ratio(F.sum("f"), F.sum("n"))).scalar()
    share = ratio(F.col("f"), F.col("n"))
    return groups.select(
        key, F.col("n").alias("transactions"), rnd(share * 100, 4).alias("fraud_rate_pct"),
        rnd(F.try_divide(share, base), 4).alias("lift"),
    ).orderBy(key)


def box_stats(df: DataFrame, value: Column, by: str = "isFraud") -> DataFrame:
    """Quartiles, whiskers (last datum within 1.5 IQR) and outlier count per group, for any number of groups."""
    data = grouped_values(df, by, value)
    q1, q2, q3 = (F.element_at("q", i) for i in (1, 2, 3))
    boxes = stage(grouped_quantiles(data, by, [0.25, 0.5, 0.75]).select(by, "n", q1.alias("q1"), q2.alias("q2"), q3.alias("q3")), "boxes")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when(F.col("v").between(F.col("q1") - reach, F.col("q3") + reach), F.col("v"))
    kept = data.join(boxes, by).groupBy(by).agg(F.min(inside).alias("lo"), F.max(inside).alias("hi"), F.count(inside).alias("kept"))
    return boxes.join(kept, by).select(
        by, F.col("n").alias("count"),
        rnd(F.col("q1"), 6).alias("q1"), rnd(F.col("q2"), 6).alias("median"), rnd(F.col("q3"), 6).alias("q3"),
        rnd(F.least("lo", "q1"), 6).alias("whisker_low"), rnd(F.greatest("hi", "q3"), 6).alias("whisker_high"),
        (F.col("n") - F.col("kept")).alias("outliers"),
    ).orderBy(by)


def kernel_density(df: DataFrame, column: str, by: str = "isFraud", points: int = 100) -> DataFrame:
    """Gaussian kernel density per group on an even grid from its minimum to its maximum.

    Bandwidth is Scott's rule, n^(-1/5) sample deviations. Rows are first counted per
    distinct value, so the work is distinct values x grid points: for a two-decimal
    score at most 10,001 x 100 per group, however many rows there are. Groups may be any number.
    (by, point, x, density, median)
    """
    data = grouped_values(df, by, F.col(column))
    spread = data.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("std"))
    medians = grouped_quantiles(data, by, [0.5]).select(by, "n", F.element_at("q", 1).alias("m"))
    stats = stage(spread.join(medians, by).withColumn("h", F.nullif(F.col("std"), F.lit(0.0)) * F.pow("n", F.lit(-0.2))), "spreads")
    counted = data.groupBy(by, "v").agg(F.count(F.lit(1)).alias("c"))
    grid = counted.join(stats, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + F.col("point") * ((F.col("hi") - F.col("lo")) / (points - 1))
    z = (x - F.col("v")) / F.col("h")
    summed = grid.groupBy(by, "point").agg(F.sum(F.col("c") * F.exp(z * z * -0.5)).alias("_sum"))
    # A group with one distinct value has no spread: density 1 at that value.
    density = F.coalesce(F.try_divide(F.col("_sum"), F.col("n") * F.col("h") * math.sqrt(2 * math.pi)), F.lit(1.0))
    return summed.join(stats, by).select(
        by, "point", rnd(x, 6).alias("x"), rnd(density, 8).alias("density"), rnd(F.col("m"), 4).alias("median"),
    ).orderBy(by, "point")


def _pairs_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, correlation) per pair. Two passes: means first, then centred products,
    which are plain sums and do not lose digits. NULL for a constant column.
    """
    columns = sorted({c for p in pairs for c in p})
    first = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.struct(F.avg(c).alias("mean"), F.count(c).alias("n"),
                 (F.min(c) == F.max(c)).alias("constant")).alias(c) for c in columns]).first()
    d = {c: F.col(c).cast("double") - F.lit(float(first[c]["mean"] or 0.0)) for c in columns}
    complete = all(first[c]["n"] == first["_n"] for c in columns)
    sums: dict[str, Column] = {}

    def total(x: str, y: str, among: tuple[str, str] | None = None) -> Column:
        x, y = sorted((x, y))
        name = f"{x}*{y}" if among is None else f"{x}*{y}|{among[0]},{among[1]}"
        if name not in sums:
            product = d[x] * d[y]
            if among is not None:
                product = F.when(F.col(among[0]).isNotNull() & F.col(among[1]).isNotNull(), product)
            sums[name] = F.sum(product).alias(name)
        return F.col(f"`{name}`")

    def shift(x: str, among: tuple[str, str]) -> Column:
        name = f"{x}|{among[0]},{among[1]}"
        both = F.col(among[0]).isNotNull() & F.col(among[1]).isNotNull()
        sums.setdefault(name, F.sum(F.when(both, d[x])).alias(name))
        return F.col(f"`{name}`")

    def both_count(pair: tuple[str, str]) -> Column:
        name = f"n|{pair[0]},{pair[1]}"
        both = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
        sums.setdefault(name, F.count_if(both).alias(name))
        return F.col(f"`{name}`")

    rows = []
    for x, y in pairs:
        if complete:
            xy, xx, yy = total(x, y), total(x, x), total(y, y)
        else:  # rows with both values only, as pairwise deletion asks
            p = (x, y)
            n, sx, sy = both_count(p), shift(x, p), shift(y, p)
            xy = total(x, y, p) - sx * sy / F.nullif(n, F.lit(0))
            xx = total(x, x, p) - sx * sx / F.nullif(n, F.lit(0))
            yy = total(y, y, p) - sy * sy / F.nullif(n, F.lit(0))
        value = F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))
        if first[x]["constant"] or first[y]["constant"]:
            value = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value.alias("correlation")))
    return df.agg(*sums.values()).select(F.inline(F.array(*rows)))


def correlation_pairs(df: DataFrame, columns: Sequence[str] = tuple(C.CORRELATED_COLUMNS)) -> DataFrame:
    """Pearson correlation of every pair below the diagonal."""
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i)]
    found = _pairs_correlation(df, pairs)
    return found.withColumn("correlation", rnd(F.col("correlation"), 6))


def top_label_correlations(df: DataFrame, label: str = "isFraud", k: int = 8,
                           columns: Sequence[str] = tuple(C.CORRELATED_COLUMNS)) -> DataFrame:
    """(feature, strength, direction): the features most correlated with the label."""
    found = _pairs_correlation(df, [(c, label) for c in columns if c != label])
    return found.select(
        F.col("x").alias("feature"),
        rnd(F.abs("correlation"), 4).alias("strength"),
        F.when(F.col("correlation") > 0, "+").otherwise("-").alias("direction"),
    ).orderBy(F.desc_nulls_last("strength"), "feature").limit(k)


def type_hour_rates(df: DataFrame) -> DataFrame:
    """Fraud rate in percent by type (rows) and hour (columns h0 to h23), 0 where empty."""
    hours = list(range(24))
    rates = df.groupBy("type").pivot("hour_of_day", hours).agg(_rate()).na.fill(0.0)
    return rates.select("type", *[F.col(str(h)).alias(f"h{h}") for h in hours]).orderBy("type")


def decile_edges(df: DataFrame, column: str = "amount", q: int = 10, strict: bool = True) -> list[float]:
    """Inner edges of q equal-frequency buckets over all rows; strict mode refuses equal edges."""
    edges = exact_quantiles(df, {column: F.col(column)}, [i / q for i in range(q + 1)])[column]
    if strict and any(a is not None and a == b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"{column} has too many equal values for {q} buckets")
    return edges[1:-1]


def _total(amount: Column) -> Column:
    """Decimal sum, the same whatever the task order."""
    return F.sum(amount.cast(MONEY))


def _mean(amount: Column) -> Column:
    return ratio(_total(amount), F.count(amount))


def decile_loss(df: DataFrame, column: str = "amount", q: int = 10, strict: bool = True) -> DataFrame:
    """(decile, fraud_count, fraud_loss_millions): fraud amount per amount decile of all rows.

    One value that spans a whole decile makes two edges equal. Strict mode raises then;
    otherwise the value counts in the lowest decile that reaches it and the others are empty.
    """
    edges = decile_edges(df, column, q, strict)
    labels = [f"D{i + 1}" for i in range(q)]
    bucket = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        bucket = F.when(F.col(column) <= F.lit(edge).cast("double"), label).otherwise(bucket)
    losses = df.where(_fraud()).groupBy(bucket.alias("decile")).agg(
        F.count(F.lit(1)).alias("fraud_count"),
        rnd(_total(F.col("amount")).cast("double") / 1e6, 6).alias("fraud_loss_millions"),
    )
    return over_domain(losses, "decile", labels, {"fraud_count": 0, "fraud_loss_millions": 0.0})


def business_metrics(df: DataFrame) -> DataFrame:
    fraud_amount = F.when(_fraud(), F.col("amount"))
    legit_amount = F.when(~_fraud(), F.col("amount"))
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("isFraud").cast("long").alias("fraud_transactions"),
        rnd(_total(fraud_amount), 2).alias("total_fraud_loss"),
        rnd(_mean(fraud_amount), 2).alias("avg_fraud_amount"),
        rnd(_mean(legit_amount), 2).alias("avg_legit_amount"),
        rnd(ratio(_mean(fraud_amount), _mean(legit_amount)), 4).alias("fraud_to_legit_ratio"),
    )


def insight_summary(df: DataFrame) -> DataFrame:
    """One row: rates and shares quoted in the written summary."""
    n = F.count(F.lit(1))

    def rate_where(condition: Column) -> Column:
        return percent(F.sum(F.when(condition, F.col("isFraud"))), F.count_if(condition), 4)

    def share(condition: Column) -> Column:
        return percent(F.count_if(condition), n, 4)

    tiers = [share(F.col("risk_tier") == t).alias(f"{t.lower()}_share_pct") for t in C.RISK_TIERS]
    fraud_amount = F.when(_fraud(), F.col("amount"))
    return df.agg(
        _rate().alias("fraud_rate_pct"),
        rate_where(F.col("type") == "CASH_OUT").alias("cash_out_rate_pct"),
        rate_where(F.col("type") == "TRANSFER").alias("transfer_rate_pct"),
        rate_where(F.col("zero_balance_after") == 1).alias("drained_rate_pct"),
        F.count_if(F.col("type") == "CASH_OUT").alias("cash_out_count"),
        share(F.col("type") == "CASH_OUT").alias("cash_out_share_pct"),
        percent(F.count_if(_fraud() & F.col("type").isin(C.FRAUD_TYPES)), F.sum("isFraud"), 4)
        .alias("fraud_in_eligible_types_pct"),
        rnd(_mean(fraud_amount), 2).alias("avg_fraud_amount"),
        rnd(_mean(F.when(~_fraud(), F.col("amount"))), 2).alias("avg_legit_amount"),
        *tiers,
    )


def account_history(txns: DataFrame, account: str | Column) -> DataFrame:
    """Every warehouse row where the account sends or receives, in time order."""
    account = F.lit(account)
    involved = (F.col("name_orig") == account) | (F.col("name_dest") == account)
    role = F.when(F.col("name_orig") == account, "sender").otherwise("receiver")
    return txns.where(involved).withColumn("role", role).orderBy("step", "id")


def dashboard_measures(txns: DataFrame) -> DataFrame:
    """Headline measures over the warehouse table.

    Detection rate is the system flag's recall. Two formulas are our own reading:
    false alarm rate = FP / (FP + TN), risk exposure = sum(amount x score / 100).
    """
    fraud, flagged = F.col("is_fraud") == 1, F.col("is_flagged_fraud") == 1
    amount, score = F.col("amount").cast("decimal(18,2)"), F.col("risk_score").cast("decimal(5,2)")
    return txns.agg(
        percent(F.count_if(fraud), F.count(F.lit(1)), 4).alias("fraud_rate_pct"),
        rnd(F.sum(F.when(fraud, amount)), 2).alias("total_fraud_loss"),
        percent(F.count_if(fraud & flagged), F.count_if(fraud), 2).alias("detection_rate_pct"),
        percent(F.count_if(~fraud & flagged), F.count_if(~fraud), 2).alias("false_alarm_rate_pct"),
        rnd(ratio(F.sum(score), F.count(score)), 2).alias("avg_risk_score"),
        rnd(F.sum(amount * score) / 100, 2).alias("risk_exposure"),
    )
