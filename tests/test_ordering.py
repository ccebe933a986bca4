"""Ranks and neighbours: the spread-out way must equal the plain window."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnrisk.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one key."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 77.5).otherwise(F.pmod(F.hash("id"), F.lit(500)) / 4).alias("v"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        (F.pmod(F.hash("id", F.lit(7)), F.lit(20))).alias("step"),
        (F.pmod(F.hash("id", F.lit(9)), F.lit(2))).alias("x"),
    )


def plain_ranks(df, ascending=True, tiles=4):
    direction = F.asc if ascending else F.desc
    w, n = Window.orderBy(direction("v")), Window.orderBy(direction("v"), "id")
    return df.select(
        "id", "v", F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense_rank"),
        F.row_number().over(n).cast("long").alias("row_number"),
        F.ntile(tiles).over(n).alias("ntile"),
        F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("group_rows", [10, 10**9])
@pytest.mark.parametrize("ascending", [True, False])
def test_global_rank_equals_plain_window(skewed, group_rows, ascending):
    df = skewed.select("id", "v")
    got = ordering.global_rank(df, "v", ascending, tiles=7, group_rows=group_rows)
    assert same(got, plain_ranks(df, ascending, 7))


def test_rank_is_the_same_for_any_partitioning(skewed):
    df = skewed.select("id", "v")
    assert same(ordering.global_rank(df, "v", group_rows=10),
                ordering.global_rank(df.repartition(13), "v", group_rows=10))


def test_rank_of_one_row_and_fewer_rows_than_tiles(spark):
    one = spark.createDataFrame([(1, 5.0)], "id long, v double")
    row = ordering.global_rank(one, "v").first()
    assert (row["rank"], row["percent_rank"], row["cume_dist"], row["ntile"]) == (1, 0.0, 1.0, 1)
    two = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    assert sorted(r["ntile"] for r in ordering.global_rank(two, "v").collect()) == [1, 2]


def test_ties_share_rank_and_leave_a_gap(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "id long, v double")
    got = {r["id"]: (r["rank"], r["dense_rank"]) for r in ordering.global_rank(df, "v").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 2)}


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("group_rows", [50, 10**9])
def test_neighbour_equals_plain_window(skewed, following, group_rows):
    prefix, step_to = ("next", F.lead) if following else ("prev", F.lag)
    w = Window.partitionBy("key").orderBy("step", "id")
    want = skewed.withColumns({f"{prefix}_{c}": step_to(c).over(w) for c in ["x", "step", "id"]})
    got = ordering.with_neighbour(skewed, "key", "step", ["x", "step", "id"],
                                  following=following, group_rows=group_rows)
    assert same(got.select(*want.columns), want)


@pytest.mark.parametrize("following", [False, True])
def test_neighbour_by_a_fine_order(skewed, following):
    """A heavy key with an order value of its own in nearly every row is still cut into few cells."""
    fine = skewed.withColumn("step", F.when(F.col("id") % 7 == 0, F.lit(500.5)).when(F.col("id") % 50 != 3, F.pmod(F.hash("id"), F.lit(10**6)) / 8))
    fine = fine.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    step_to = F.lead if following else F.lag
    want = fine.withColumn("near", step_to("id").over(Window.partitionBy("key").orderBy("step", "id")))
    got = ordering.with_neighbour(fine, "key", "step", ["id"], following=following, group_rows=50)
    assert same(got.toDF(*want.columns), want)


def test_only_some_keys(skewed):
    only = skewed.select("key").where("key in ('hot', 'k3')").distinct()
    w = Window.partitionBy("key").orderBy("step", "id")
    want = skewed.withColumn("prev_x", F.lag("x").over(w)).where("key in ('hot', 'k3')")
    got = ordering.with_neighbour(skewed, "key", "step", ["x"], only=only, group_rows=200)
    assert same(got.select(*want.columns), want)


def test_heavy_keys_found(skewed):
    assert [r["key"] for r in ordering.heavy_keys(skewed, "key", 500).collect()] == ["hot"]
    assert ordering.heavy_keys(skewed, "key", 2000) is None


def test_running_totals_end_at_the_total(skewed):
    rows = ordering.running_totals(skewed, "v", {"n": F.count(F.lit(1))}).orderBy("v").collect()
    assert rows[0]["n_before"] == 0
    assert rows[-1]["n_before"] + rows[-1]["n"] == rows[-1]["n_total"] == 3000


def test_missing_values_are_refused_not_lost(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id long, v double")
    with pytest.raises(ValueError, match="missing in 1"):
        ordering.global_rank(df, "v")


def test_missing_order_keeps_the_row(skewed):
    gaps = skewed.withColumn("step", F.when(F.col("id") % 11 != 0, F.col("step")))
    w = Window.partitionBy("key").orderBy("step", "id")
    got = ordering.with_neighbour(gaps, "key", "step", ["id"], group_rows=50)
    assert same(got, gaps.withColumn("prev_id", F.lag("id").over(w)).select(*got.columns))


def test_ranges_follow_rows():
    assert ordering.range_count(0, 8) == 16
    assert ordering.range_count(1_000_000, 200) == 200
    for rows in (10**9, 10**10, 6 * 10**10):
        assert rows / ordering.range_count(rows, 200) <= ordering.GROUP_ROWS
    assert ordering.range_count(10**13, 200) == ordering.MAX_RANGES


def test_ranks_with_few_rows_per_range(skewed, monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_ROWS", 50)
    found = ordering.global_rank(skewed, "v")
    want = {r["id"]: r["rank"] for r in plain_ranks(skewed).collect()}
    assert {r["id"]: r["rank"] for r in found.select("id", "rank").collect()} == want
