"""Stored tree models as tables: importances, shapes and rules from their node files, and rules that decide.

MLlib stores a tree model's nodes as Parquet rows. Everything here is worked out from those rows
with joins and aggregates; only the rules of one tree, as many as it has leaves, become an expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.functions import constants as C

FEATURES = tuple(C.MODEL_FEATURES)
DEEPEST = 30  # MLlib's own limit


def node_table(spark: SparkSession, folder: str) -> DataFrame:
    """(tree, id, prediction, stats, weight, gain, left, right, feature, threshold) of a stored pipeline's tree model.

    ``stats`` are the weighted rows of each class in the node, ``weight`` is their sum. Leaves have no children.
    """
    rows = spark.read.parquet(f"{folder.rstrip('/')}/stages/*Classifier*/data")
    if "nodeData" in rows.columns:  # an ensemble
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = rows.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    return rows.select(
        "tree", "id", "prediction", F.col("impurityStats").alias("stats"),
        F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x).alias("weight"), "gain",
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"))


def importances(nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, value, above_mean): each feature's share of the gain, per tree and then over all trees.

    A feature that no tree uses has 0. A tree of one node takes no part.
    """
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    totals = gains.groupBy("tree").agg(F.sum("g").alias("all"))
    shares = gains.join(totals, "tree").groupBy("feature").agg(F.sum(F.try_divide("g", "all")).alias("share"))
    trees = totals.where(F.col("all") != 0).agg(F.count(F.lit(1))).scalar()
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(n).alias("name")) for i, n in enumerate(features)]))
    names = nodes.sparkSession.range(1).select(listed.alias("x")).select("x.*")
    value = F.coalesce(F.try_divide(F.col("share"), trees), F.lit(0.0))
    return (names.join(shares, "feature", "left")
            .select(F.col("name").alias("feature"), value.alias("value"), (value > 1.0 / len(features)).alias("above_mean"))
            .orderBy(F.desc("value"), "feature"))


def shapes(nodes: DataFrame) -> DataFrame:
    """(trees, depth, leaves) of a model: one row."""
    depths = leaf_paths(nodes).select("tree", F.size("path").alias("d"))
    return depths.agg(F.count_distinct("tree").cast("int").alias("trees"), F.max("d").alias("depth"),
                      F.count(F.lit(1)).cast("int").alias("leaves"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, path, prediction, weight) of every leaf; ``path`` has (feature, left, threshold) from the root on.

    A step down the trees is a join of the nodes reached with their children, ``DEEPEST`` steps at the most.
    """
    kept = ("tree", "id", "prediction", "weight", "left", "right", "feature", "threshold")
    at = nodes.where("id = 0").select(*kept, F.array().cast("array<struct<feature:int,left:boolean,threshold:double>>").alias("path"))
    out = []
    for _ in range(DEEPEST + 1):
        out.append(at.where("left is null").select("tree", F.col("id").alias("leaf"), "path", "prediction", "weight"))
        inner = at.where("left is not null")
        if inner.isEmpty():
            break
        children = F.explode(F.array(*[
            F.struct(F.col(side).alias("id"), F.concat("path", F.array(F.struct("feature", F.lit(side == "left").alias("left"), "threshold"))).alias("path"))
            for side in ("left", "right")])).alias("child")
        down = inner.select("tree", children).select("tree", "child.*")
        at = down.join(nodes.select(*kept), ["tree", "id"])
    return reduce(DataFrame.unionByName, out)


def rules(nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(tree, leaf, rule, prediction, weight): each leaf's conditions as text that Spark SQL can evaluate."""
    names = F.array(*[F.lit(n) for n in features])
    condition = F.transform("path", lambda s: F.concat(
        F.element_at(names, s["feature"] + 1), F.when(s["left"], F.lit(" <= ")).otherwise(F.lit(" > ")), s["threshold"].cast("string")))
    text = F.when(F.size("path") > 0, F.array_join(condition, " AND ")).otherwise("always")
    return leaf_paths(nodes).select("tree", "leaf", text.alias("rule"), F.col("prediction").cast("int").alias("prediction"), "weight")


def compile_rules(nodes: DataFrame, features: Sequence[str] = FEATURES) -> Column:
    """An array column with (leaf, prediction) of every rule of one tree that holds for a row.

    The driver sees the tree's leaves. Rules are evaluated one by one, each from its own
    conditions, so that a row's array shows whether exactly one of them holds.
    """
    tests = []
    for r in leaf_paths(nodes).collect():
        holds = F.lit(True)
        for s in r["path"]:
            x, edge = F.col(features[s["feature"]]).cast("double"), F.lit(s["threshold"])
            holds = holds & ((x <= edge) if s["left"] else (x > edge))
        tests.append(F.when(holds, F.struct(F.lit(r["leaf"]).alias("leaf"), F.lit(int(r["prediction"])).alias("prediction"))))
    return F.array_compact(F.array(*tests))


def decide(df: DataFrame, nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``df`` plus n_rules (rules that hold), rule (the leaf) and rule_prediction of the first of them."""
    held = df.withColumn("_held", compile_rules(nodes, features))
    return held.select(*df.columns, F.size("_held").alias("n_rules"), F.try_element_at("_held", F.lit(1))["leaf"].alias("rule"),
                       F.try_element_at("_held", F.lit(1))["prediction"].alias("rule_prediction"))


def logistic_gradient(frame: DataFrame, means: Sequence[float], deviations: Sequence[float], coefficients: Sequence[float],
                      intercept: float, penalty: float, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, gradient) of the mean weighted loss plus penalty x |b|^2 / 2 at the given coefficients, in one aggregate.

    At the optimum every component is 0, that of the intercept too; the loss is convex, so a gradient near 0
    certifies the fit whatever solver found it. ``frame`` has features, label and weight.
    """
    scaled = [(F.col(f).cast("double") - F.lit(m)) / F.lit(d) if d else F.lit(0.0) for f, m, d in zip(features, means, deviations)]
    margin = reduce(lambda a, b: a + b, [x * F.lit(c) for x, c in zip(scaled, coefficients)], F.lit(intercept))
    held = frame.select(*[x.alias(f) for f, x in zip(features, scaled)], "weight",
                        (F.col("weight") * (F.lit(1.0) / (F.exp(-margin) + 1.0) - F.col("label"))).alias("pull"))
    sums = held.agg(F.sum("weight").alias("w"), F.sum("pull").alias("intercept"),
                    *[F.sum(F.col("pull") * F.col(f)).alias(f"g_{f}") for f in features])
    rows = [F.struct(F.lit(f).alias("feature"), (F.col(f"g_{f}") / F.col("w") + F.lit(penalty * c)).alias("gradient"))
            for f, c in zip(features, coefficients)]
    rows.append(F.struct(F.lit("intercept").alias("feature"), (F.col("intercept") / F.col("w")).alias("gradient")))
    return sums.select(F.inline(F.array(*rows)))
