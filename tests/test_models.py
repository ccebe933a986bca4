"""Evaluation on hand-computed cases; models by quality bands."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from txnrisk.functions import constants as C
from txnrisk.operators import balanced, evaluate, learn, model_tables
from txnrisk.plans import training_run
from txnrisk.plans.catalog import feat
from txnrisk.session import stage

SMALL = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.55), (0, 0.4), (1, 0.3), (0, 0.2), (0, 0.1), (0, 0.1)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, "label int, score double")


def test_metrics_by_hand(small):
    row = evaluate.model_metrics(small, digits=6).first()
    # Above 0.5: 3 hits of 5. Pairs ranked right: 6 + 6 + 5 + 3 of 24.
    assert (row["precision"], row["recall"]) == (0.6, 0.75)
    assert row["f1"] == pytest.approx(2 / 3, abs=1e-6)
    assert row["roc_auc"] == pytest.approx(20 / 24, abs=1e-6)
    assert row["avg_precision"] == pytest.approx((1 + 1 + 3 / 4 + 4 / 7) / 4, abs=1e-6)


def test_tied_scores_share_one_point(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    row = evaluate.model_metrics(tied).first()
    assert (row["roc_auc"], row["avg_precision"], row["recall"]) == (0.5, 0.5, 0.0)
    assert evaluate.curve_points(tied, "roc").count() == 2


def test_no_fraud_gives_zero_metrics(spark):
    row = evaluate.model_metrics(spark.createDataFrame([(0, 0.2)], "label int, score double")).first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.0, 0.0, 0.0, None)


def test_exactly_half_is_not_fraud(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.0), (1, 0.99996)], "isFraud int, p double")
    rows = evaluate.with_alerts(df, "p").collect()
    assert [r["fraud_label"] for r in rows] == [0, 0, 1]
    assert [r["alert_priority"] for r in rows] == ["Medium", None, "Critical"]
    assert rows[2]["fraud_probability"] == 1.0


def test_curve_ends(small):
    roc = evaluate.curve_points(small, "roc").orderBy(F.desc_nulls_first("threshold")).collect()
    assert roc[0][:] == (None, 0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    pr = evaluate.curve_points(small, "pr").orderBy(F.desc_nulls_first("threshold")).collect()
    assert (pr[0]["recall"], pr[0]["precision"]) == (0.0, 1.0)
    assert (pr[-1]["recall"], pr[-1]["precision"], pr[-1]["baseline"]) == (1.0, 0.4, 0.4)
    with pytest.raises(ValueError):
        evaluate.curve_points(small, "other")


def test_report_lines(small):
    rows = {r["class"]: r for r in evaluate.classification_report(small).collect()}
    assert rows["accuracy"]["f1"] == 0.7 and rows["accuracy"]["support"] == 10
    assert (rows["Legitimate"]["precision"], rows["Legitimate"]["recall"]) == (0.8, 0.6667)
    assert rows["macro avg"]["precision"] == 0.7


def test_split_sizes():
    assert learn.test_sizes({0: 14706, 1: 294}, 0.2) == {0: 2941, 1: 59}
    assert sum(learn.test_sizes({0: 7, 1: 4}, 0.2).values()) == 3


def test_split_is_exact_and_repeatable(spark, sf):
    base = feat(spark, sf)
    train, test = learn.stratified_split(base)
    again = learn.stratified_split(base.repartition(5))[1]
    assert (train.count(), test.count()) == (1200, 300)
    assert test.agg(F.sum("isFraud")).first()[0] == 8
    assert test.select("id").exceptAll(again.select("id")).isEmpty()
    assert train.select("id").intersect(test.select("id")).isEmpty()


def test_training_rows_are_spread_by_their_number(spark, sf, monkeypatch):
    """A partition of the training part is bounded however many rows there are, and leaves memory to the fits."""
    seen = []
    for name in ("fit_logistic", "fit_tree", "fit_forest"):
        monkeypatch.setattr(learn, name, lambda frame: seen.append((frame.rdd.getNumPartitions(), frame.storageLevel.useMemory, frame.count())))
    base = feat(spark, sf)
    training_run.train_models(base, partitions=8)
    monkeypatch.setattr(training_run, "PARTITION_ROWS", 100)
    training_run.train_models(base, partitions=8)
    training_run.train_models(base)
    assert seen == [(8, False, 1200)] * 3 + [(12, False, 1200)] * 6
    assert training_run.spread(100, None, 100) is None


def test_split_of_more_than_64_classes(spark):
    df = spark.range(1400).selectExpr("id", "cast(id % 70 as int) as isFraud")
    train, test = learn.stratified_split(df)
    assert {r["isFraud"]: r["count"] for r in test.groupBy("isFraud").count().collect()} == {c: 4 for c in range(70)}
    assert train.count() == 1400 - 280 and train.join(test, "id").count() == 0


@pytest.fixture(scope="module")
def trained(spark):
    from txnrisk.session import stage
    return training_run.train_models(stage(feat(spark, "/root/testdata/sf0.01"), "test-features"))


def test_models_rank_well(trained):
    rows = training_run.compare_models(trained).collect()
    assert [r["Model"] for r in rows] == training_run.MODEL_ORDER
    assert all(r["ROC-AUC"] > 0.85 and r["Recall"] >= 0.75 for r in rows)


def test_logistic_minimises_the_penalised_weighted_loss(spark, sf):
    """Against Newton's method on sum(weight x loss) x C + |b|^2 / 2, population scaling."""
    frame = learn.training_frame(feat(spark, sf)).persist()
    data = np.array([[*r] for r in frame.collect()])
    x, y, w = data[:, :14], data[:, 14], data[:, 15]
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    ridge = np.diag([1.0] * 14 + [0.0])
    b = np.zeros(15)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        gradient = 0.1 * z.T @ (w * (p - y)) + ridge @ b
        hessian = 0.1 * (z * (w * p * (1 - p))[:, None]).T @ z + ridge
        b -= np.linalg.solve(hessian, gradient)
    model = learn.fit_logistic(frame)
    got = learn.probabilities(model, frame).select("amount", "newbalanceDest", "probability_of_fraud").collect()
    want = {(r[0], r[4]): p for r, p in zip(x, 1 / (1 + np.exp(-z @ b)))}
    assert max(abs(want[r[0], r[1]] - r[2]) for r in got) < 2e-3


def test_best_prefers_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame(
        [(0, "A", 0.8, 0.9), (1, "B", 0.8, 0.95), (2, "C", 0.7, 0.95)],
        "place int, Model string, Recall double, `ROC-AUC` double")
    assert training_run.best_models(df).first()[:] == ("A", "B")


def test_scores_trace_back_to_rows(trained):
    scored = learn.score(trained.models["Random Forest"], trained.test)
    assert scored.columns[0] == "id" and len(scored.columns) == 19
    assert scored.count() == trained.test.count()


@pytest.fixture(scope="module")
def folder(trained, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    learn.save_models(trained.models, path)
    return path


def nodes(spark, folder, name):
    return model_tables.node_table(spark, learn.model_path(folder, name))


def test_importances_from_node_files_are_the_models_own(spark, trained, folder):
    for name in ("Random Forest", "Decision Tree"):
        got = {r["feature"]: r["value"] for r in model_tables.importances(nodes(spark, folder, name)).collect()}
        want = trained.models[name].stages[-1].featureImportances.toArray()
        assert [got[f] for f in model_tables.FEATURES] == pytest.approx(want, abs=1e-12)
        assert sum(got.values()) == pytest.approx(1.0)
    assert len(learn.logistic_strength(trained.models["Logistic Regression"], spark).collect()) == 14


def test_importances_in_duckdb(spark, folder):
    """The same sums in SQL over the same files."""
    con = duckdb.connect()
    data = f"read_parquet('{learn.model_path(folder, 'Random Forest')}/stages/*Classifier*/data/*.parquet')"
    want = dict(con.execute(f"""
        WITH n AS (SELECT treeID AS tree, nodeData AS d FROM {data}),
        g AS (SELECT tree, d.split.featureIndex AS feature, sum(d.gain * list_sum(d.impurityStats)) AS g FROM n WHERE d.leftChild >= 0 GROUP BY ALL),
        s AS (SELECT feature, g / sum(g) OVER (PARTITION BY tree) AS s FROM g)
        SELECT feature, sum(s) / (SELECT count(DISTINCT tree) FROM g) FROM s GROUP BY feature""").fetchall())
    got = {r["feature"]: r["value"] for r in model_tables.importances(nodes(spark, folder, "Random Forest")).collect()}
    assert [got[f] for f in model_tables.FEATURES] == pytest.approx([want.get(i, 0.0) for i in range(14)], abs=1e-12)


def test_shapes_and_rules(spark, trained, folder):
    tree, forest = trained.models["Decision Tree"].stages[-1], trained.models["Random Forest"].stages[-1]
    rules = model_tables.rules(nodes(spark, folder, "Decision Tree")).collect()
    assert len(rules) == (tree.numNodes + 1) // 2
    assert model_tables.shapes(nodes(spark, folder, "Decision Tree")).first()[:] == (1, tree.depth, len(rules))
    shape = model_tables.shapes(nodes(spark, folder, "Random Forest")).first()
    assert shape[:] == (100, max(t.depth for t in forest.trees), sum((t.numNodes + 1) // 2 for t in forest.trees))
    assert tree.depth <= 6 and shape["depth"] <= 8


def test_rules_decide_like_the_tree(spark, trained, folder):
    """Compiled rules, and their text as SQL: each row meets one rule, and it predicts as the model does."""
    table = nodes(spark, folder, "Decision Tree")
    scored = trained.models["Decision Tree"].transform(trained.test)
    decided = model_tables.decide(scored, table)
    assert decided.where("n_rules <> 1 OR rule_prediction <> prediction").isEmpty() and decided.count() == trained.test.count()
    called, met = F.lit(None).cast("int"), F.lit(0)
    for r in model_tables.rules(table).collect():
        called = F.when(F.expr(r["rule"]), r["prediction"]).otherwise(called)
        met = met + F.when(F.expr(r["rule"]), 1).otherwise(0)
    assert scored.where((called != F.col("prediction")) | (met != 1)).isEmpty()


def test_a_tree_of_one_leaf(spark, tmp_path):
    frame = spark.range(40).selectExpr(*[f"CAST(1 AS DOUBLE) AS {f}" for f in model_tables.FEATURES],
                                       "CAST(id % 4 = 0 AS DOUBLE) AS label", "1.0D AS weight")
    learn.save_models({"Decision Tree": learn.fit_tree(frame)}, str(tmp_path))
    table = nodes(spark, str(tmp_path), "Decision Tree")
    assert [r["rule"] for r in model_tables.rules(table).collect()] == ["always"]
    assert model_tables.decide(frame, table).where("n_rules = 1 AND rule_prediction = 0").count() == 40
    assert {r["value"] for r in model_tables.importances(table).collect()} == {0.0}
    assert model_tables.shapes(table).first()[:] == (1, 0, 1)


def test_balanced_samples_and_forest(spark, trained):
    """Draws follow the Poisson distribution, weigh the classes alike in every tree, and the forest ranks as well as the other."""
    drawn = spark.range(20_000).select(balanced.draws("id", 3).alias("k")).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 20_000 for r in drawn}
    assert [share[k] for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.012)
    forest = balanced.fit_balanced_forest(trained.train, trees=8)
    for tree in forest.trees[:3]:  # the stored weights of the root: half for each class
        root = tree.trees[0]._call_java("rootNode").impurityStats().stats()
        assert root[0] == pytest.approx(root[1])
    metrics = lambda df: evaluate.model_metrics(df.select(F.col("isFraud").alias("label"), F.col("p").alias("score"))).first()
    got = metrics(forest.probabilities(trained.test, "p"))
    other = metrics(learn.probabilities(trained.models["Random Forest"], trained.test, "p"))
    assert got["roc_auc"] > 0.85 and got["avg_precision"] > 0.7 * other["avg_precision"]


def test_the_forest_keeps_node_ids_and_is_the_same(spark, sf):
    frame = learn.training_frame(feat(spark, sf)).persist()
    kept = learn.fit_forest(frame, trees=5).stages[-1]
    assert kept.getOrDefault("cacheNodeIds")
    other = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=5, maxDepth=8, minInstancesPerNode=10, featureSubsetStrategy="sqrt",
        maxBins=learn.MAX_BINS, seed=C.SEED).fit(VectorAssembler(inputCols=C.MODEL_FEATURES, outputCol="features").transform(frame))
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert trees(kept) == trees(other)


def test_a_large_forest_keeps_no_node_ids_and_is_the_same(spark, sf, monkeypatch):
    """Ids are kept as long as rows x trees stay within the bound, whatever the rows."""
    frame = learn.training_frame(feat(spark, sf)).persist()
    kept = learn.fit_forest(frame, trees=5).stages[-1]
    monkeypatch.setattr(learn, "KEPT_NODES", frame.count() * 5)
    assert learn.fit_forest(frame, trees=5).stages[-1].getOrDefault("cacheNodeIds")
    monkeypatch.setattr(learn, "KEPT_NODES", frame.count() * 5 - 1)
    walked = learn.fit_forest(frame, trees=5).stages[-1]
    assert not walked.getOrDefault("cacheNodeIds")
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert trees(kept) == trees(walked)


def test_a_query_fits_the_models_it_names_only(spark, sf, monkeypatch):
    """leaf_rows needs no forest, scored_transactions nothing but the forest; nothing is fitted twice."""
    from txnrisk.plans import catalog
    fitted = []
    for name in ("fit_logistic", "fit_tree", "fit_forest"):
        monkeypatch.setattr(learn, name, lambda frame, name=name, fit=getattr(learn, name): fitted.append(name) or fit(frame))
    monkeypatch.setattr(catalog, "_trained", {})
    monkeypatch.setattr(catalog, "_stored", {})
    assert catalog.bootstrap_samples(spark, sf).count() == 20 and fitted == []
    assert catalog.leaf_rows(spark, sf).first()[:] == (True, 0) and fitted == ["fit_tree"]
    assert catalog.scored_transactions(spark, sf).count() == 300 and fitted == ["fit_tree", "fit_forest"]
    assert [r["Model"] for r in catalog.model_comparison(spark, sf).collect()] == training_run.MODEL_ORDER
    assert catalog.model_shapes(spark, sf).count() == 2 and fitted == ["fit_tree", "fit_forest", "fit_logistic"]


def test_models_fitted_one_by_one_are_those_fitted_together(spark, sf):
    base = stage(feat(spark, sf), "test-features")
    together = training_run.train_models(base, partitions=8)
    alone = training_run.split_parts(base)
    for name in reversed(training_run.MODEL_ORDER):
        alone = training_run.fit_models(alone, [name], 8)
    assert list(alone.models) == training_run.MODEL_ORDER
    for name in ("Decision Tree", "Random Forest"):
        trees = [t.models[name].stages[-1].toDebugString.split("\n", 1)[1] for t in (together, alone)]
        assert trees[0] == trees[1]
    a, b = (t.models["Logistic Regression"].stages[-1].coefficients.toArray() for t in (together, alone))
    assert a == pytest.approx(b, rel=1e-6)


def test_draws_of_all_trees_at_once(spark):
    """The stored draws are those that each tree's own expression gives, missing and repeated keys too."""
    df = spark.range(500).selectExpr("CASE WHEN id % 50 <> 0 THEN id % 400 END AS id")
    each = [balanced.draws("id", t).alias(f"k{t}") for t in range(4)]
    rows = df.select(balanced.all_draws("id", 4).alias("all"), *each).collect()
    assert len(rows) == 500 and all(list(r["all"]) == [r[f"k{t}"] for t in range(4)] for r in rows)


def test_metric_agreement_scores_each_model_twice(spark, monkeypatch):
    """Once for the comparison and once, stored, for the three evaluators."""
    from txnrisk.plans import catalog
    stored = []
    monkeypatch.setattr(catalog, "stage", lambda df, purpose: stored.append(purpose) or stage(df, purpose))
    rows = catalog.metric_agreement(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 3 and all(r["roc_auc"] and r["recall"] and r["precision"] for r in rows)
    assert stored.count("evaluated") == 3


def test_gradient_certifies_the_optimum(spark, sf, tmp_path):
    frame = learn.training_frame(feat(spark, sf)).persist()
    model = learn.fit_logistic(frame)
    assert learn.logistic_certificate(model, frame).where("NOT optimal").isEmpty()
    scaler, fitted = model.stages[1], model.stages[-1]
    off = [float(x) for x in fitted.coefficients]
    off[0] += 0.05

    def gradient(coefficients):
        rows = model_tables.logistic_gradient(frame, [float(x) for x in scaler.mean], [float(x) for x in scaler.std],
                                              coefficients, float(fitted.intercept), fitted.getRegParam())
        return {r["feature"]: r["gradient"] for r in rows.collect()}

    got = gradient(off)
    assert abs(got["amount"]) > 1e-4  # beside the optimum it does not hold
    frame.write.parquet(str(tmp_path / "frame"))
    margin = " + ".join(f"(\"{f}\" - {m!r}) / {d!r} * {c!r}" for f, m, d, c in zip(
        model_tables.FEATURES, map(float, scaler.mean), map(float, scaler.std), off))
    for f, m, d, c in zip(model_tables.FEATURES, map(float, scaler.mean), map(float, scaler.std), off):
        want = duckdb.connect().execute(f"""SELECT sum(weight * (1 / (1 + exp(-({fitted.intercept!r} + {margin}))) - label) * (("{f}" - {m!r}) / {d!r}))
                              / sum(weight) + {fitted.getRegParam() * c!r} FROM read_parquet('{tmp_path}/frame/*.parquet')""").fetchone()[0]
        assert got[f] == pytest.approx(want, abs=1e-9)


def test_many_classes_make_no_deep_expression(spark):
    df = spark.range(3000).selectExpr("id", "CAST(id % 300 AS INT) AS isFraud", *[f"CAST(id AS DOUBLE) AS {f}" for f in model_tables.FEATURES])
    frame = learn.training_frame(df)
    assert frame.where("abs(weight - 1) > 1e-9 OR weight IS NULL").isEmpty()


def test_stored_model_scores_the_same(spark, trained, tmp_path):
    learn.save_models(trained.models, str(tmp_path))
    for name, model in trained.models.items():
        back = learn.load_model(str(tmp_path), name)
        a, b = learn.score(model, trained.test), learn.score(back, trained.test)
        assert a.exceptAll(b).isEmpty()
