import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rows import raw
from txnrisk.operators import cleaning, quality
from txnrisk.plans import cleaning_run
from txnrisk.plans.catalog import dirty
from txnrisk.sources import files


def test_expected_counts(spark, sf):
    soiled = dirty(spark, sf)
    assert soiled.count() == 1501
    assert quality.duplicate_rows(soiled).first()[0] == 1
    assert quality.invalid_amounts(soiled).first()[0] == 2
    missing = {r["column"]: r["count"] for r in quality.missing_report(soiled).collect()}
    assert missing == {"oldbalanceDest": 12, "newbalanceDest": 9}
    prepared = cleaning_run.prepare(soiled)
    learned = prepared.learned
    assert (prepared.distinct.count(), prepared.valid.count()) == (1500, 1498)
    assert learned.cap == pytest.approx(499407.55886)
    done = cleaning_run.clean(soiled, learned)
    assert len(done.columns) == 25
    assert done.where("amount > amount_capped").count() == 2
    assert done.agg(F.sum("isFraud"), F.sum("is_extreme_amount")).first()[:] == (38, 899)


def test_rows_equal_only_after_filling_collapse(spark):
    df = raw(spark, {"oldbalanceDest": None}, {"oldbalanceDest": 0.0})
    assert cleaning_run.valid_rows(df, {}).count() == 1


def test_fills(spark):
    df = raw(spark, {"amount": 1.0, "nameOrig": "b"}, {"amount": 4.0, "nameOrig": "a"},
             {"amount": None, "nameOrig": "a", "step": None}, {"amount": 2.0, "nameOrig": "b"},
             {"amount": 3.0, "nameOrig": None, "isFraud": None}, {"amount": 9.0, "isFraud": 1, "nameOrig": "z"})
    fills = cleaning_run.learn_fills(df)
    assert fills == {"step": 1.0, "amount": 3.0, "nameOrig": "a", "isFraud": 0.0}
    out = cleaning.fill_missing(df, fills)
    assert dict(out.dtypes)["isFraud"] == "int"
    assert quality.missing_report(out).isEmpty()


def test_fractional_median_turns_column_to_double(spark):
    df = raw(spark, {"step": 1}, {"step": 2}, {"step": None})
    out = cleaning.fill_missing(df, cleaning_run.learn_fills(df))
    assert [r["step"] for r in out.collect()] == [1.0, 2.0, 1.5]


def test_column_without_values_stays_missing(spark):
    df = raw(spark, {"type": None, "amount": None}, {"type": None, "amount": None})
    assert cleaning_run.learn_fills(df) == {}


def test_unknown_type(spark):
    df = raw(spark, {"type": "WIRE"}, {"type": "DEBIT"})
    assert [r["type_encoded"] for r in cleaning.encode_types(df).collect()] == [4]
    assert [r["type"] for r in cleaning.unknown_types(df).collect()] == ["WIRE"]
    with pytest.raises(PySparkException, match="WIRE"):
        cleaning.encode_types(df, strict=True).collect()


def test_validation_reports_and_raises(spark):
    df = raw(spark, {"oldbalanceOrg": -1.0, "amount": 5.0})
    done = cleaning_run.clean(df, cleaning_run.Learned({}, 10.0))
    failed = {r["check"]: r["violations"] for r in quality.validate(done).collect() if not r["passed"]}
    assert failed == {"no_missing_values": 1}
    with pytest.raises(ValueError, match="no_missing_values"):
        quality.validate(done, strict=True)


def test_validation_of_an_uncleaned_frame(spark):
    report = {r["check"]: r["passed"] for r in quality.validate(raw(spark, {}, {"amount": 0.0})).collect()}
    assert report == {"no_missing_values": True, "amounts_positive": False, "risk_score_present": False,
                      "types_encoded": False, "no_duplicate_rows": True}


def test_cleaning_again_changes_only_the_cap(spark, sf):
    learned = cleaning_run.prepare(dirty(spark, sf)).learned
    once = cleaning_run.clean(dirty(spark, sf), learned)
    twice = cleaning_run.clean(once.select(*cleaning_run.C.RAW_COLUMNS), learned)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_empty_input(spark):
    empty = raw(spark, {}).where("1 = 0")
    assert cleaning_run.clean(empty).count() == 0
    assert {r["check"]: r["value"] for r in quality.audit(empty).collect()}["duplicates"] == 0


@pytest.mark.parametrize("as_csv", [False, True])
def test_file_to_file(spark, sf, tmp_path, as_csv):
    source, target = str(tmp_path / "raw"), str(tmp_path / "clean")
    files.write_csv(dirty(spark, sf), source)
    done = cleaning_run.run(spark, source, target, as_csv=as_csv)
    assert (done.table.count(), len(done.table.columns)) == (1498, 25)
    assert done.checks.where("not passed").isEmpty()
    assert done.steps.where("step = 'drop duplicates'").first()["detail"] == "1 removed"
    assert done.audit.where("check = 'invalid_amounts'").first()["value"] == 2


def test_csv_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"
    path.write_text("\n".join([
        head, "1, cash_out ,NA,C1,null,NaN,M1,,n/a,0,0", "2.0,DEBIT,12.5,None,oops,1,M1,1,1,1,0"]) + "\n")
    got = files.read_csv(spark, str(path))
    rows = got.orderBy("step").collect()
    assert rows[0][:] == (1, "CASH_OUT", None, "C1", None, None, "M1", None, None, 0, 0)
    assert rows[1][:] == (2, "DEBIT", 12.5, None, None, 1.0, "M1", 1.0, 1.0, 1, 0)
    bad = files.malformed_cells(spark, str(path)).collect()
    assert [r[:] for r in bad] == [("oldbalanceOrg", 1)]
    assert files.scan_diagnostics(got).first()["rows"] == 2


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("isFraud,amount,note,type,step,nameOrig,nameDest,oldbalanceOrg,newbalanceOrig,"
                    "oldbalanceDest,newbalanceDest,isFlaggedFraud\n1,9.5,x,DEBIT,3,C1,M2,1,2,3,4,0\n")
    row = files.read_csv(spark, str(path)).first()
    assert (row["step"], row["amount"], row["isFraud"], row["nameDest"]) == (3, 9.5, 1, "M2")


def test_csv_without_rows(spark, sf, tmp_path):
    path = str(tmp_path / "none")
    files.write_csv(dirty(spark, sf).where("amount < 0"), path)
    assert files.read_csv(spark, path).count() == 0


def test_missing_labels_are_refused(spark):
    from txnrisk.operators import learn

    df = spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 2 AS int) END AS isFraud")
    with pytest.raises(ValueError, match="10 rows"):
        learn.stratified_split(df)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, 2.0), (5.0, None, float("nan")), (-1.0, 1.0, 1.0)],
                               "amount double, oldbalanceDest double, newbalanceDest double")
    found = {r["column"]: r["count"] for r in quality.missing_report(df).collect()}
    assert found == {"amount": 1, "oldbalanceDest": 1, "newbalanceDest": 1}
    assert cleaning.drop_invalid_amounts(df).count() == 1
    assert cleaning.gaps(cleaning.fill_zero_balances(df)) == ["amount"]


def test_fractions_do_not_fit_whole_numbers(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("step,amount\n1.7,2.5\n2.0,1\n3,x\n")
    kinds = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("amount", T.DoubleType())])
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), kinds).collect()
    assert [r["step"] for r in rows] == [None, 2, 3]
    bad = {r["column"]: r["malformed"] for r in files.malformed_cells(spark, str(tmp_path / "a.csv"), kinds).collect()}
    assert bad == {"step": 1, "amount": 1}


def test_learned_fills_cover_new_gaps(spark, sf):
    from txnrisk.functions import constants as C
    from txnrisk.plans import catalog, cleaning_run

    raw = catalog.raw(spark, sf).select(*C.RAW_COLUMNS)
    learned = cleaning_run.prepare(raw).learned
    holes = raw.selectExpr(*[f"IF(step % 2 = 0, NULL, {c}) AS {c}" if c in ("oldbalanceOrg", "nameDest") else c for c in raw.columns])
    assert holes.where("oldbalanceOrg IS NULL").count() > 0
    done = cleaning_run.clean(holes, learned)
    assert done.where("oldbalanceOrg IS NULL OR nameDest IS NULL OR risk_tier IS NULL").count() == 0


def test_missing_heavy_key(spark):
    from txnrisk.operators import ordering

    df = spark.range(300).selectExpr("id", "IF(id % 3 = 0, NULL, concat('k', id % 7)) AS k", "CAST(id % 5 AS int) AS step", "id AS v")
    plain = ordering.with_neighbour(df, "k", "step", ["v"]).orderBy("id").collect()
    cut = ordering.with_neighbour(df, "k", "step", ["v"], group_rows=50).select(*df.columns, "prev_v").orderBy("id").collect()
    assert [r["prev_v"] for r in plain] == [r["prev_v"] for r in cut]
