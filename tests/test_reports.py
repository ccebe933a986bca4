"""Edge cases of the reports: empty input, no fraud, no flags, equal amounts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import raw, raw_with_id
from txnrisk.functions.features import add_features
from txnrisk.operators import grouped, investigate as I, kpi, profile as P
from txnrisk.plans.catalog import feat, txns
from txnrisk.sources import warehouse


def table(spark, *changes):
    return warehouse.to_warehouse(add_features(raw_with_id(spark, *changes)))


def test_kpis_of_nothing(spark):
    row = kpi.kpi_summary(table(spark, {}).where("1 = 0")).first()
    assert row["total_transactions"] == 0
    assert row["fraud_rate_pct"] is None and row["flag_coverage_pct"] is None


def test_no_fraud_and_no_flags(spark):
    row = kpi.flag_precision_recall(table(spark, {}, {"amount": 5.0})).first()
    assert row["true_negatives"] == 2
    assert row["precision_pct"] is None and row["recall_pct"] is None
    text = I.executive_summary(table(spark, {})).first()
    assert text["Total Fraud Loss"] == "$0.00" and text["Avg Fraud Amount"] is None


def test_groups_add_up(spark, sf):
    base = txns(spark, sf)
    total = kpi.kpi_summary(base).first()
    by_type = kpi.fraud_by_type(base).agg(F.sum("total_count"), F.sum("fraud_count")).first()
    assert by_type[:] == (total["total_transactions"], total["total_fraud_count"])
    cells = kpi.flag_precision_recall(base).first()
    assert sum(cells[:4]) == total["total_transactions"]


def test_running_total_ends_at_the_total(spark, sf):
    base = txns(spark, sf)
    last = I.hourly_running_loss(base).collect()[-1]
    assert last["cumulative_fraud_loss"] == kpi.kpi_summary(base).first()["total_fraud_loss"]


def test_absent_hours_are_skipped(spark):
    base = table(spark, *[{"step": s, "type": "TRANSFER", "isFraud": 1, "amount": a}
                          for s, a in ((1, 30.0), (5, 60.0), (9, 90.0), (20, 30.0))])
    rows = I.hourly_running_loss(base).collect()
    assert [r["rolling_3hr_avg_loss"] for r in rows] == [30.0, 45.0, 60.0, 60.0]


def test_tied_amounts_across_the_cut(spark):
    base = table(spark, *[{"type": "TRANSFER", "isFraud": 1, "amount": a, "step": i + 1}
                          for i, a in enumerate([50.0, 40.0, 40.0, 40.0, 10.0])])
    rows = I.amount_percentiles(base, k=2).collect()
    assert [(r["amount"], r["amount_percentile"], r["cumulative_distribution"]) for r in rows] == [
        (50.0, 100.0, 100.0), (40.0, 25.0, 80.0)]


def test_all_amounts_when_k_exceeds_rows(spark):
    rows = I.amount_percentiles(table(spark, {"amount": 1.0}), scope="all", k=20).collect()
    assert [(r["amount_percentile"], r["cumulative_distribution"]) for r in rows] == [(0.0, 100.0)]


def test_previous_means_any_kind(spark):
    fraud = {"type": "TRANSFER", "isFraud": 1}
    base = table(spark, {**fraud, "step": 1}, {"step": 2}, {**fraud, "step": 3}, {**fraud, "step": 7})
    rows = I.repeat_fraud(base).collect()
    assert [(r["step"], r["hours_since_last_txn"]) for r in rows] == [(7, 4)]


@pytest.mark.parametrize("k", [10, None])
def test_repeat_fraud_with_heavy_senders(spark, sf, k):
    base = txns(spark, sf)
    plain, cut = I.repeat_fraud(base, k), I.repeat_fraud(base, k, group_rows=3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    assert plain.count() == (10 if k else 17)


def test_report_parameters_fold_away(spark, sf):
    plan = I.fraud_report(txns(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_results_do_not_depend_on_partitioning(spark, sf):
    base = txns(spark, sf)
    for report in (kpi.kpi_summary, kpi.fraud_by_tier, I.executive_summary, I.sender_ranking):
        assert report(base).collect() == report(base.repartition(7)).collect()


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, 1.0, 0), (0.1, 2.0, 1), (0.1, 4.0, 1)], "a double, b double, isFraud int")
    got = {(r["x"], r["y"]): r["correlation"] for r in P.correlation_pairs(df, ["a", "b", "isFraud"]).collect()}
    assert got[("b", "a")] is None and got[("isFraud", "a")] is None
    assert got[("isFraud", "b")] == pytest.approx(0.755929)


def test_correlation_leaves_out_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0)], "a double, b double")
    want = df.dropna().agg(F.corr("a", "b")).first()[0]
    assert P.correlation_pairs(df, ["a", "b"]).first()["correlation"] == pytest.approx(want, abs=1e-6)


def test_equal_deciles_raise(spark):
    with pytest.raises(ValueError, match="equal values"):
        P.decile_loss(raw(spark, *[{"amount": 5.0}] * 20))


def test_histogram_of_one_value(spark):
    rows = P.histogram(raw(spark, {"amount": 7.0}, {"amount": 7.0}), F.col("amount"), 4).collect()
    assert [r["count"] for r in rows] == [0, 0, 2, 0]
    assert (rows[0]["bin_start"], rows[-1]["bin_end"]) == (6.5, 7.5)


def test_density_areas_are_one(spark, sf):
    for r in P.class_amount_density(feat(spark, sf)).groupBy("isFraud").agg(
            F.sum(F.col("density") * (F.col("bin_end") - F.col("bin_start"))).alias("area")).collect():
        assert r["area"] == pytest.approx(1.0, abs=1e-3)


def test_missing_tier_is_zero(spark):
    rows = P.tier_fraud_rate(add_features(raw(spark, {}))).collect()
    assert [(r["risk_tier"], r["transactions"]) for r in rows] == [
        ("Low", 1), ("Medium", 0), ("High", 0), ("Critical", 0)]


def test_pivot_fills_absent_hours(spark):
    row = P.type_hour_rates(add_features(raw(spark, {"isFraud": 1}))).first()
    assert (row["h1"], row["h0"], len(row)) == (100.0, 0.0, 25)


def test_lonely_group_has_point_density(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0)], "isFraud int, v double")
    rows = [r for r in P.kernel_density(df, "v", points=5).collect() if r["isFraud"] == 1]
    assert {(r["x"], r["density"]) for r in rows} == {(2.0, 1.0)}


def test_a_hundred_groups(spark):
    df = spark.range(5000).selectExpr("id % 100 AS g", "CAST(pmod(hash(id), 1000) AS DOUBLE) / 8 AS v")
    got = {r["g"]: r for r in P.box_stats(df, F.col("v"), by="g").collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert got.keys() == values.keys() and len(got) == 100
    for g, vs in values.items():
        q1, q2, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        inside = [v for v in vs if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        want = (len(vs), q1, q2, q3, min(*inside, q1), max(*inside, q3), len(vs) - len(inside))
        assert tuple(got[g])[1:] == pytest.approx(want, abs=1e-6)


def test_layout_round_trip(spark, sf, tmp_path):
    base = txns(spark, sf)
    warehouse.write_warehouse(base, str(tmp_path / "t"), files=3)
    back = warehouse.read_warehouse(spark, str(tmp_path / "t"))
    assert base.exceptAll(back).isEmpty() and back.exceptAll(base).isEmpty()
    plan = I.fraud_counts_by_type(back)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_fraud,1)" in plan


def test_stamp_and_keys(spark):
    stamped = warehouse.to_warehouse(add_features(raw(spark, {}, {"amount": 3.0})), stamp=True)
    assert stamped.columns[-1] == "created_at"
    assert warehouse.key_collisions(stamped).first()[0] == 0
    numbered = warehouse.with_sequence(raw(spark, *[{"step": i} for i in range(1, 50)]), buckets=8)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1, 50))


def test_introspection(spark, sf):
    base = warehouse.register_view(txns(spark, sf), "transactions")
    described = warehouse.describe_table(base).collect()
    assert (len(described), described[3]["dtype"]) == (23, "decimal(18,2)")
    plan = I.explain_sql(
        spark, "SELECT type, count(*) AS n FROM transactions WHERE is_fraud = 1 GROUP BY type").first()
    assert "HashAggregate" in plan["plan"]


def test_catalog_table_answers_sql(spark, sf, tmp_path):
    base = txns(spark, sf)
    table = warehouse.save_table(base, "stored_transactions", str(tmp_path / "t"))
    assert table.dtypes == base.dtypes
    row = spark.sql("SELECT count(*) AS n, sum(is_fraud) AS f FROM stored_transactions WHERE type = 'TRANSFER'").first()
    want = base.where("type = 'TRANSFER'").agg(F.count("*"), F.sum("is_fraud")).first()
    assert row[:] == want[:]
    spark.sql("DROP TABLE stored_transactions")


def test_groups_of_every_kind(spark):
    """A hot group, groups of one row, of one value, without values, and rows without a group."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 7 THEN NULL ELSE concat('g', id % 400) END AS g",
                                      "CASE WHEN id % 400 = 8 THEN NULL WHEN id % 400 = 9 THEN 2.5D ELSE CAST(id AS DOUBLE) END AS v")
    boxes = {r["g"]: r for r in P.box_stats(df, F.col("v"), "g").collect()}
    assert "g8" not in boxes and None not in boxes and boxes["hot"]["count"] == 2100
    assert (boxes["g9"]["q1"], boxes["g9"]["whisker_high"], boxes["g9"]["outliers"]) == (2.5, 2.5, 0)
    bins = P.histogram(df, F.col("v"), 4, by="g")
    assert bins.count() == 4 * len(boxes) and bins.agg(F.sum("count")).first()[0] == df.where("g is not null and v is not null").count()
    dense = P.kernel_density(df, "v", "g", points=3)
    assert dense.count() == 3 * len(boxes) and dense.where("density is null or x is null").isEmpty()


@pytest.mark.parametrize("bins", [3, 2048])
def test_grouped_quantiles_need_no_more_passes_for_more_groups(spark, bins, monkeypatch):
    passes = []
    narrowed = grouped._narrowed
    monkeypatch.setattr(grouped, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    probs, made = [0.0, 0.1, 0.5, 0.999, 1.0], []
    for groups in (2, 60):
        df = spark.range(groups * 30).selectExpr(f"id % {groups} AS g", f"pow(floor(id / {groups}) - 14.5, 3) AS v")
        values = grouped.grouped_values(df, "g", F.col("v"))
        passes.clear()
        for r in grouped.grouped_quantiles(values, "g", probs, bins).collect():
            assert r["n"] == 30 and r["q"] == pytest.approx(np.quantile([(i - 14.5) ** 3 for i in range(30)], probs))
        made.append(len(passes))
    assert made[0] == made[1]
    assert grouped.grouped_quantiles(values.limit(0), "g", probs).count() == 0
