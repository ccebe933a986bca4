"""Classifier evaluation over any (label, score) frame; label is 0/1, score is in [0, 1].

Rows are first counted per distinct score. Running counts over scores are kept in
ranges (see ``ordering``), so curves and areas are exact for any number of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.functions.scalars import ratio, right_closed, rnd
from txnrisk.operators.ordering import running_totals
from txnrisk.operators.profile import over_domain

CLASS_NAMES = ["Legitimate", "Fraud"]


def _score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, highest first: positives and negatives here, before and in total."""
    hit = F.col(label) == 1
    return running_totals(
        scored, score, {"pos": F.count_if(hit), "neg": F.count_if(~hit)}, ascending=False)


def _zero_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def confusion_counts(scored: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp with "score above threshold" as the prediction."""
    hit, called = F.col(label) == 1, F.col(score) > threshold
    return scored.agg(
        F.count_if(~hit & ~called).alias("tn"), F.count_if(~hit & called).alias("fp"),
        F.count_if(hit & ~called).alias("fn"), F.count_if(hit & called).alias("tp"))


def confusion_matrix(scored: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """(actual, predicted, count): all four cells, zeros included."""
    cells = [("Legitimate", "Legitimate", "tn"), ("Legitimate", "Fraud", "fp"),
             ("Fraud", "Legitimate", "fn"), ("Fraud", "Fraud", "tp")]
    rows = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
            for a, p, c in cells]
    return confusion_counts(scored, label, score, threshold).select(F.inline(F.array(*rows)))


def threshold_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                      threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the fraud class; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion_counts(scored, label, score, threshold).select(
        rnd(_zero_ratio(tp, tp + fp), 4).alias("precision"),
        rnd(_zero_ratio(tp, tp + fn), 4).alias("recall"),
        rnd(_zero_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


def classification_report(scored: DataFrame, label: str = "label", score: str = "score",
                          threshold: float = 0.5) -> DataFrame:
    """(class, precision, recall, f1, support) per class, accuracy, macro and weighted means.

    The accuracy row carries the accuracy in ``f1`` only.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    legit = (_zero_ratio(tn, tn + fn), _zero_ratio(tn, n0), _zero_ratio(2 * tn, 2 * tn + fn + fp))
    fraud = (_zero_ratio(tp, tp + fp), _zero_ratio(tp, n1), _zero_ratio(2 * tp, 2 * tp + fp + fn))
    macro = tuple((a + b) / 2 for a, b in zip(legit, fraud))
    weighted = tuple(_zero_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(legit, fraud))
    none = F.lit(None).cast("double")

    def line(name, values, support):
        p, r, f = values
        return F.struct(F.lit(name).alias("class"), rnd(p, 4).alias("precision"),
                        rnd(r, 4).alias("recall"), rnd(f, 4).alias("f1"), support.alias("support"))

    return confusion_counts(scored, label, score, threshold).select(F.inline(F.array(
        line("Legitimate", legit, n0), line("Fraud", fraud, n1),
        line("accuracy", (none, none, _zero_ratio(tn + tp, n0 + n1)), n0 + n1),
        line("macro avg", macro, n0 + n1), line("weighted avg", weighted, n0 + n1),
    )))


def curve_points(scored: DataFrame, kind: str = "roc", label: str = "label",
                 score: str = "score") -> DataFrame:
    """One point per distinct score plus the starting point, which has no threshold.

    ``roc``: (threshold, fpr, tpr). ``pr``: (threshold, recall, precision, baseline), the
    baseline being the share of positives.
    """
    counts = _score_counts(scored, label, score)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    threshold = F.col(score).cast("double").alias("threshold")
    start = scored.sparkSession.range(1)
    nothing = F.lit(None).cast("double").alias("threshold")
    if kind == "roc":
        points = counts.select(
            threshold, rnd(ratio(fp, F.col("neg_total")), 8).alias("fpr"),
            rnd(ratio(tp, F.col("pos_total")), 8).alias("tpr"))
        first = start.select(nothing, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    elif kind == "pr":
        share = rnd(ratio(F.col("pos_total"), F.col("pos_total") + F.col("neg_total")), 8)
        points = counts.select(
            threshold, rnd(ratio(tp, F.col("pos_total")), 8).alias("recall"),
            rnd(ratio(tp, tp + fp), 8).alias("precision"), share.alias("baseline"))
        base = scored.agg(rnd(ratio(F.count_if(F.col(label) == 1), F.count(F.lit(1))), 8)).scalar()
        first = start.select(nothing, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
                             base.alias("baseline"))
    else:
        raise ValueError("kind is 'roc' or 'pr'")
    return first.unionByName(points)


def model_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                  threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """One row: precision, recall, f1, roc_auc, avg_precision.

    Area under ROC sums trapezoids per distinct score. Average precision is the step
    sum of recall gain x precision. Both are NULL when a class is missing.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_all, neg_all = F.first("pos_total"), F.first("neg_total")
    above = F.col(score) > threshold
    tp = F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0))
    reached = F.col("pos_before") + F.col("pos")
    step = pos * ratio(reached, reached + F.col("neg_before") + F.col("neg"))
    area = F.sum(neg * (F.col("pos_before") + pos / 2))
    return _score_counts(scored, label, score).agg(
        rnd(_zero_ratio(tp, tp + fp), digits).alias("precision"),
        rnd(_zero_ratio(tp, pos_all), digits).alias("recall"),
        rnd(_zero_ratio(2 * tp, tp + fp + pos_all), digits).alias("f1"),
        rnd(ratio(area, pos_all.cast("double") * neg_all), digits).alias("roc_auc"),
        rnd(ratio(F.sum(step), pos_all), digits).alias("avg_precision"),
    )


def alert_priority(probability: Column) -> Column:
    """Right-closed bands above 0; a probability of exactly 0 has no priority."""
    return right_closed(probability, C.ALERT_EDGES, C.ALERT_PRIORITIES, above=0.0)


def with_alerts(scored: DataFrame, probability: str, actual: str = "isFraud") -> DataFrame:
    """Add the rounded probability, label above 0.5, actual class and priority.

    Label and priority look at the unrounded probability.
    """
    p = F.col(probability)
    return scored.withColumns({
        "fraud_label": F.when(p > 0.5, 1).otherwise(0),
        "alert_priority": alert_priority(p),
        "actual_fraud": F.col(actual).cast("int"),
        "fraud_probability": rnd(p, 4),
    })


def priority_counts(alerts: DataFrame) -> DataFrame:
    """(alert_priority, count) over the four bands, empty ones included."""
    counts = alerts.groupBy("alert_priority").agg(F.count(F.lit(1)).alias("count"))
    return over_domain(counts, "alert_priority", C.ALERT_PRIORITIES, {"count": 0})


def priority_hit_rate(alerts: DataFrame) -> DataFrame:
    """One row: rows in High and Critical, the fraud among them and its share."""
    urgent = F.col("alert_priority").isin(C.QUEUE_TIERS)
    caught = F.count_if(urgent & (F.col("actual_fraud") == 1))
    return alerts.agg(
        F.count_if(urgent).alias("urgent_rows"), caught.alias("urgent_fraud"),
        rnd(ratio(caught, F.count_if(urgent)) * 100, 1).alias("urgent_fraud_pct"))
