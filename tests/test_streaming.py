from pyspark.sql import functions as F

from rows import raw
from txnrisk.functions import constants as C
from txnrisk.plans.catalog import raw as mapped
from txnrisk.plans.cleaning_run import Learned
from txnrisk.sources import files
from txnrisk.streaming import live


def test_two_arrivals_add_up(spark, sf, tmp_path):
    """Rows arriving later change the windows they fall in; nothing is counted twice."""
    inbox, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows = mapped(spark, sf).select(*C.RAW_COLUMNS)
    learned = Learned({}, 1000.0)

    def figures():
        return live.hourly_figures(live.score_stream(live.read_stream(spark, inbox), learned))

    files.write_parquet(rows.where("step <= 400"), inbox)
    live.run_available(figures(), work)
    rows.where("step > 400").write.mode("append").parquet(inbox)
    out = live.run_available(figures(), work)
    total = out.agg(F.sum("transactions"), F.sum("fraud_count"), F.count("*")).first()
    assert total[:2] == (1500, 38)
    assert total[2] == rows.select("step").distinct().count()


def test_stream_features_equal_batch(spark, tmp_path):
    rows = raw(spark, {"amount": 5000.0, "oldbalanceDest": None}, {"amount": 0.0})
    got = live.score_stream(rows, Learned({}, 1000.0)).first()
    assert (got["amount_capped"], got["oldbalanceDest"], got["type_encoded"]) == (1000.0, 0.0, 1)


def test_a_row_two_months_late_counts(spark, tmp_path):
    inbox, work = str(tmp_path / "in"), str(tmp_path / "work")
    learned = Learned({}, 1000.0)

    def figures():
        return live.hourly_figures(live.score_stream(live.read_stream(spark, inbox), learned))

    files.write_parquet(raw(spark, {"step": 1500}), inbox)
    live.run_available(figures(), work)
    raw(spark, {"step": 1501}).write.mode("append").parquet(inbox)
    live.run_available(figures(), work)
    raw(spark, {"step": 2}).write.mode("append").parquet(inbox)
    assert live.run_available(figures(), work).agg(F.sum("transactions")).first()[0] == 3


def test_what_scoring_leaves_out(spark):
    rows = raw(spark, {}, {"amount": 0.0}, {"amount": float("nan")}, {"amount": None}, {"type": "GIFT"}, {"type": None})
    learned = Learned({}, 1000.0)
    assert sorted(r["reason"] for r in live.rejected(rows, learned).collect()) == ["amount"] * 3 + ["type"] * 2
    assert live.score_stream(rows, learned).count() == 1
