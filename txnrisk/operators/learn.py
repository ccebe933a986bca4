"""MLlib models: split, fit, score, explain, store."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.functions import constants as C
from txnrisk.operators.evaluate import with_alerts
from txnrisk.operators.model_tables import logistic_gradient
from txnrisk.operators.quantiles import kth_smallest

LABEL = "isFraud"
MAX_BINS = 128
#: Most node ids, one for each row and tree, that a forest's fit keeps between its levels. MLlib holds those of three levels
#: at a time, 4 bytes each: some 1.2 GB in all.
KEPT_NODES = 100_000_000
# Classes whose cuts one pass finds, each as a column of its own.
MAX_CLASSES = 64


def _hash(key: str, seed: int) -> Column:
    """52 bits of the md5 of key and seed: exact as a double, and other engines have it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Rows per class. The driver holds one number per class, however many there are."""
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[label]: r["n"] for r in found}


def test_sizes(counts: Mapping[int, int], share: float) -> dict[int, int]:
    """Rows per class for the test part: proportional, largest remainders rounded up."""
    total = sum(counts.values())
    wanted = math.ceil(total * share)
    exact = {c: wanted * n / total for c, n in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    by_rest = sorted(counts, key=lambda c: (sizes[c] - exact[c], c))
    for c in by_rest[:wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(df: DataFrame, label: str = LABEL, test: float = 0.2, seed: int = C.SEED,
                     key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact class shares.

    A row is in the test part when the hash of its key is at most its class's cut, the
    k-th smallest hash. The cut is found by counting, so no class is sorted in one task,
    and membership depends on the key alone: the split is the same on every run. Cuts are found
    for MAX_CLASSES classes a pass. Rows without a label belong to neither part, so they raise, with their number.
    """
    counts = class_counts(df, label)
    if None in counts:
        raise ValueError(f"{label} is missing in {counts[None]} rows; fill or leave them out before the split")
    sizes = {c: k for c, k in test_sizes(counts, test).items() if k > 0}
    h = _hash(key, seed)
    classes, cuts = list(sizes), {}
    for i in range(0, len(classes), MAX_CLASSES):
        some = classes[i:i + MAX_CLASSES]
        streams = {str(c): F.when(F.col(label) == F.lit(c), h) for c in some}
        cuts |= kth_smallest(df, streams, {str(c): (sizes[c], counts[c]) for c in some})
    tests = [(F.col(label) == F.lit(c)) & (h <= F.lit(cuts[str(c)])) for c in classes] or [F.lit(False)]
    while len(tests) > 1:  # in pairs, so that many classes make no deep expression
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    chosen = tests[0]
    return df.where(~chosen), df.where(chosen)


def split_membership(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """(key, part) of every row of a split."""
    return (train.select(key, F.lit("train").alias("part"))
            .unionByName(test.select(key, F.lit("test").alias("part"))))


def split_summary(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    """(part, label, rows) of a split."""
    parts = [p.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("part"), "label", "rows")
             for name, p in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def class_weights(df: DataFrame, label: str = LABEL, counts: Mapping[int, int] | None = None) -> dict[int, float]:
    """Balanced weights rows / (classes x rows of the class). ``counts`` are the ``class_counts`` of ``df``, if known."""
    counts = class_counts(df, label) if counts is None else counts
    return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}


def training_frame(train: DataFrame, features: Sequence[str] = tuple(C.MODEL_FEATURES),
                   label: str = LABEL, counts: Mapping[int, int] | None = None) -> DataFrame:
    """Feature columns as doubles, the label and the balanced weight."""
    weights = class_weights(train, label, counts)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])  # one expression, however many classes
    weight = F.try_element_at(table, F.col(label)) if weights else F.lit(None).cast("double")
    return train.select(*[F.col(f).cast("double").alias(f) for f in features],
                        F.col(label).cast("double").alias("label"), weight.alias("weight"))


def fit_logistic(frame: DataFrame, features: Sequence[str] = tuple(C.MODEL_FEATURES),
                 c: float = 0.1, max_iter: int = 1000) -> PipelineModel:
    """Scaled logistic regression. Balanced weights add up to the rows, so a penalty of
    1/C on the summed loss is 1/(C x rows) on MLlib's mean loss. The factor (n-1)/n makes
    up for scaling by the sample rather than the population deviation.
    """
    n = frame.count()
    penalty = (n - 1) / n / (c * n)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"),
        LogisticRegression(labelCol="label", weightCol="weight", regParam=penalty,
                           elasticNetParam=0.0, standardization=False, maxIter=max_iter),
    ]).fit(frame)


def fit_tree(frame: DataFrame, features: Sequence[str] = tuple(C.MODEL_FEATURES)) -> PipelineModel:
    """Depth 6, leaves of at least 10 rows (which makes any split at least 20)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=6,
                               minInstancesPerNode=10, maxBins=MAX_BINS, seed=C.SEED),
    ]).fit(frame)


def fit_forest(frame: DataFrame, features: Sequence[str] = tuple(C.MODEL_FEATURES),
               trees: int = 100) -> PipelineModel:
    """Depth 8, leaves of at least 10 rows, square-root feature subsets.

    Balanced weights are those of the whole training part; MLlib does not reweight
    each bootstrap sample. The node that a row has reached in each tree is kept between levels, up to ``KEPT_NODES``:
    the trees are the same, and no row walks down from their roots again at every level. Beyond that, rows walk:
    kept ids would be most of the memory, and push MLlib's copy of the rows to disk at every level.
    """
    keep = frame.count() * trees <= KEPT_NODES
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=8,
                               minInstancesPerNode=10, featureSubsetStrategy="sqrt",
                               maxBins=MAX_BINS, cacheNodeIds=keep, seed=C.SEED),
    ]).fit(frame)


def probabilities(model: PipelineModel, df: DataFrame, out: str = "probability_of_fraud") -> DataFrame:
    """``df`` plus the fraud probability, without MLlib's own columns."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def score(model: PipelineModel, df: DataFrame, key: str = "id",
          features: Sequence[str] = tuple(C.MODEL_FEATURES)) -> DataFrame:
    """Key, features, probability, label, actual class and alert priority."""
    alerts = with_alerts(probabilities(model, df), "probability_of_fraud", LABEL)
    return alerts.select(key, *features, "fraud_probability", "fraud_label", "actual_fraud",
                         "alert_priority")


def logistic_strength(model: PipelineModel, spark: SparkSession,
                      features: Sequence[str] = tuple(C.MODEL_FEATURES)) -> DataFrame:
    """(feature, value, above_mean): absolute coefficients of the scaled features."""
    values = [abs(float(x)) for x in model.stages[-1].coefficients]
    mean = sum(values) / len(values)
    rows = sorted(((n, v, v > mean) for n, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, value double, above_mean boolean")


def logistic_certificate(model: PipelineModel, frame: DataFrame, features: Sequence[str] = tuple(C.MODEL_FEATURES),
                         tolerance: float = 1e-4) -> DataFrame:
    """(feature, optimal): whether the gradient at the fitted coefficients is within ``tolerance`` of 0."""
    scaler, fitted = model.stages[1], model.stages[-1]
    gradient = logistic_gradient(frame, [float(x) for x in scaler.mean], [float(x) for x in scaler.std],
                                 [float(x) for x in fitted.coefficients], float(fitted.intercept), fitted.getRegParam(), features)
    return gradient.select("feature", (F.abs("gradient") < tolerance).alias("optimal"))


def model_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name.lower().replace(' ', '_')}"


def save_models(models: Mapping[str, PipelineModel], folder: str) -> None:
    """One folder per model; the scaler is part of the logistic one."""
    for name, model in models.items():
        model.write().overwrite().save(model_path(folder, name))


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(model_path(folder, name))
