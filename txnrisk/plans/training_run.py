"""Cleaned transactions to trained, compared and stored models and a scored alert list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.operators import evaluate, learn
from txnrisk.session import stage

FITS = {
    "Logistic Regression": lambda frame: learn.fit_logistic(frame),
    "Decision Tree": lambda frame: learn.fit_tree(frame),
    "Random Forest": lambda frame: learn.fit_forest(frame),
}
MODEL_ORDER = list(FITS)
#: Training rows of one partition. The forest keeps some 1,000 bytes of each, a partition's in one piece.
PARTITION_ROWS = 150_000


@dataclass(frozen=True)
class Trained:
    models: Mapping[str, PipelineModel]
    train: DataFrame
    test: DataFrame
    counts: Mapping[int, int]  # rows per class of the training part


def train_models(df: DataFrame, key: str = "id", partitions: int | None = None) -> Trained:
    """Split and fit the three models."""
    return fit_models(split_parts(df, key), MODEL_ORDER, partitions)


def split_parts(df: DataFrame, key: str = "id") -> Trained:
    """The split alone, no model fitted yet."""
    train, test = learn.stratified_split(df, key=key)
    return Trained({}, train, test, learn.class_counts(train))


def fit_models(trained: Trained, names: Sequence[str] = tuple(MODEL_ORDER), partitions: int | None = None) -> Trained:
    """``trained`` plus those of the named models that it does not have yet. A fit depends on the training part
    alone, not on the other fits. That part is kept while the fits iterate over it, on disk: memory is for the rows
    in the form that the fits themselves keep.

    ``partitions`` spreads the training part when it comes from fewer files than cores; large ones
    have as many more as ``PARTITION_ROWS`` asks for.
    """
    missing = [n for n in MODEL_ORDER if n in names and n not in trained.models]
    if not missing:
        return trained
    frame = learn.training_frame(trained.train, counts=trained.counts)
    parts = spread(sum(trained.counts.values()), partitions, PARTITION_ROWS)
    if parts:
        frame = frame.repartition(parts)
    frame = frame.persist(StorageLevel.DISK_ONLY)
    try:
        models = {**trained.models, **{n: FITS[n](frame) for n in missing}}
    finally:
        frame.unpersist()
    return replace(trained, models={n: models[n] for n in MODEL_ORDER if n in models})


def spread(rows: int, partitions: int | None, most: int) -> int | None:
    """Partitions for ``rows``: as many as asked for, or more where they would hold over ``most`` rows; none asked for and none needed: none."""
    needed = -(-rows // most)
    return max(partitions or 0, needed) if partitions or needed > 1 else None


def test_scores(trained: Trained, name: str) -> DataFrame:
    """(label, score) of one model on the test part, stored: evaluation passes over it several times."""
    scored = learn.probabilities(trained.models[name], trained.test)
    pairs = scored.select(F.col(learn.LABEL).alias("label"), F.col("probability_of_fraud").alias("score"))
    return stage(pairs, "scores")


def compare_models(trained: Trained) -> DataFrame:
    """One row per model in training order, with the display names of the metrics."""
    rows = None
    for place, name in enumerate(trained.models):
        metrics = evaluate.model_metrics(test_scores(trained, name)).select(
            F.lit(place).alias("place"), F.lit(name).alias("Model"),
            F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
            F.col("f1").alias("F1-Score"), F.col("roc_auc").alias("ROC-AUC"),
            F.col("avg_precision").alias("Avg Precision"))
        rows = metrics if rows is None else rows.unionByName(metrics)
    return rows


def best_models(comparison: DataFrame) -> DataFrame:
    """One row: best recall and best area under ROC; the earlier model wins a tie."""
    early = -F.col("place")
    return comparison.agg(
        F.max_by("Model", F.struct("Recall", early)).alias("best_recall"),
        F.max_by("Model", F.struct("`ROC-AUC`", early)).alias("best_roc_auc"))


def run(df: DataFrame, model_folder: str | None = None, key: str = "id",
        partitions: int | None = None):
    """(trained, comparison, scored test part); stores the models when given a folder."""
    trained = train_models(df, key, partitions)
    comparison = compare_models(trained)
    scored = learn.score(trained.models["Random Forest"], trained.test, key, C.MODEL_FEATURES)
    if model_folder:
        learn.save_models(trained.models, model_folder)
    return trained, comparison, scored
