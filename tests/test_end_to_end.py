"""CSV file to cleaned table, warehouse, reports, profiles, models and alerts."""

from txnrisk.operators import investigate, kpi
from txnrisk.plans import cleaning_run, reporting_run, training_run
from txnrisk.plans.catalog import dirty
from txnrisk.sources import files, schema as S, warehouse


def test_whole_way(spark, sf, tmp_path):
    source = str(tmp_path / "raw")
    files.write_csv(dirty(spark, sf), source)
    cleaned = cleaning_run.run(spark, source, str(tmp_path / "cleaned")).table

    warehouse.write_warehouse(warehouse.to_warehouse(cleaned), str(tmp_path / "transactions"), files=2)
    txns = warehouse.read_warehouse(spark, str(tmp_path / "transactions"))
    assert kpi.kpi_summary(txns).first()["total_transactions"] == 1498
    assert warehouse.key_collisions(txns).first()[0] == 0

    reports = reporting_run.reports(txns)
    assert len(reports) == 20
    reporting_run.write_all(reports, str(tmp_path / "reports"))
    back = spark.read.parquet(str(tmp_path / "reports" / "executive_summary"))
    assert back.first()["Total Transactions"] == 1498
    view = warehouse.register_view(reports["investigation_queue"], reporting_run.QUEUE_VIEW)
    top = spark.sql(f"SELECT case_id FROM {reporting_run.QUEUE_VIEW} ORDER BY risk_score DESC LIMIT 5")
    assert (len(view.columns), top.count()) == (17, 5)
    assert investigate.fraud_report(txns, "Critical").where("risk_tier <> 'Critical'").isEmpty()

    profiles = reporting_run.profiles(cleaned)
    assert profiles["business_metrics"].first()["total_transactions"] == 1498
    assert all(table.count() > 0 for table in profiles.values())

    files.write_csv(cleaned, str(tmp_path / "cleaned-csv"))
    reread = files.read_csv(spark, str(tmp_path / "cleaned-csv"), S.CLEANED)
    assert reread.schema == cleaned.schema
    assert cleaned.exceptAll(reread).isEmpty() and reread.exceptAll(cleaned).isEmpty()

    keyed = warehouse.with_sequence(cleaned)
    trained, comparison, alerts = training_run.run(keyed, str(tmp_path / "models"))
    assert comparison.count() == len(trained.models) == 3
    assert alerts.count() == trained.test.count() == 300
