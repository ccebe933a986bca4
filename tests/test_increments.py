"""Appends with ids that go on counting, stored tables by sender, and objects of the SQL catalog."""

import pytest
from pyspark.sql import functions as F, types as T

from txnrisk.operators import investigate as I
from txnrisk.plans import catalog
from txnrisk.plans.catalog import txns
from txnrisk.sources import catalog_objects, increments, warehouse

KINDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), warehouse.CREATED])


def batch(spark, start, n):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))


def ids(spark, folder):
    return {r["k"]: r["id"] for r in increments.read_appended(spark, folder, KINDS).collect()}


@pytest.mark.parametrize("order", ["k", None])
def test_ids_go_on_and_a_retried_batch_keeps_its_own(spark, tmp_path, order):
    folder = str(tmp_path / "t")
    add = lambda name, df: increments.append_batch(df, folder, name, order=order, tie="k")
    assert add("a", batch(spark, 100, 30)) == (1, 30)
    first = ids(spark, folder)
    assert add("b", batch(spark, 0, 20).repartition(7)) == (31, 20)
    assert add("a", batch(spark, 100, 30).repartition(5)) == (1, 30)
    both = ids(spark, folder)
    assert sorted(both.values()) == list(range(1, 51)) and first.items() <= both.items()
    if order:
        assert [both[k] for k in range(100, 130)] == list(range(1, 31)) and both[0] == 31
    with pytest.raises(ValueError, match="30 rows"):
        add("a", batch(spark, 100, 31))
    assert increments.read_appended(spark, folder, KINDS).where("created_at is null").isEmpty()


def test_a_batch_that_failed_takes_its_reserved_range(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    increments.append_batch(batch(spark, 0, 5), folder, "a", order="k", tie="k")
    number_rows = increments.number_rows

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(increments, "number_rows", lost)
    with pytest.raises(RuntimeError):
        increments.append_batch(batch(spark, 10, 5), folder, "b", order="k", tie="k")
    monkeypatch.setattr(increments, "number_rows", number_rows)
    assert len(ids(spark, folder)) == 5  # what is reserved and not written is not read
    assert increments.append_batch(batch(spark, 20, 5), folder, "c", order="k", tie="k") == (11, 5)
    assert increments.append_batch(batch(spark, 10, 5), folder, "b", order="k", tie="k") == (6, 5)
    found = ids(spark, folder)
    assert sorted(found.values()) == list(range(1, 16)) and [found[k] for k in range(10, 15)] == [6, 7, 8, 9, 10]
    assert increments.high_water(spark, folder) == 15 and increments.high_water(spark, str(tmp_path / "none")) == 0


def test_an_empty_batch_takes_no_ids(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert increments.append_batch(batch(spark, 0, 0), folder, "a", order="k", tie="k") == (1, 0)
    assert increments.append_batch(batch(spark, 0, 3), folder, "b", order="k", tie="k") == (1, 3)
    assert sorted(ids(spark, folder).values()) == [1, 2, 3]


def test_reports_by_sender_shuffle_nothing_by_sender(spark, sf):
    stored = catalog.by_sender(spark, sf)
    assert stored.exceptAll(txns(spark, sf)).isEmpty() and stored.count() == txns(spark, sf).count()
    for report in (I.repeat_fraud(stored, k=None), stored.groupBy("name_orig").count()):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(name_orig" not in plan
    plain = I.repeat_fraud(txns(spark, sf), k=None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name_orig" in plain
    assert sorted(map(str, I.repeat_fraud(stored).collect())) == sorted(map(str, I.repeat_fraud(txns(spark, sf)).collect()))


def test_report_function(spark, sf):
    name = catalog_objects.create_report(spark, catalog.catalog_name(spark, sf))
    for arguments, want in (("'Critical', 0", ("Critical", False)), ("p_fraud_only => 1", ("ALL", True)),
                            ("p_fraud_only => 1, p_risk_tier => 'High'", ("High", True)), ("", ()), ("'none such'", ("none such",))):
        got = spark.sql(f"SELECT * FROM {name}({arguments})")
        assert sorted(got.collect()) == sorted(I.fraud_report(txns(spark, sf), *want).collect())
    plan = spark.sql(f"SELECT * FROM {name}('High', 1)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(risk_tier,High)" in plan and "EqualTo(is_fraud,1)" in plan  # folded and pushed to the scan


def test_report_function_over_a_session_view(spark, sf):
    txns(spark, sf).createOrReplaceTempView("session_transactions")
    name = catalog_objects.create_report(spark, "session_transactions", "session_report", temporary=True)
    assert spark.sql(f"SELECT * FROM {name}()").count() == I.fraud_report(txns(spark, sf)).count()


def test_queue_view_follows_its_table(spark, sf):
    name = catalog_objects.create_queue(spark, catalog.catalog_name(spark, sf))
    got, want = spark.table(name), I.investigation_queue(txns(spark, sf))
    assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
