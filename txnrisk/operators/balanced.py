"""A forest whose trees each balance the classes of their own bootstrap sample.

MLlib's forest takes one weight per row for all trees. Here every tree has its own sample, drawn by a hash of
row key and tree: how often a row is drawn follows the Poisson distribution of mean 1, as sampling with
replacement does on many rows, and depends on nothing else, so a sample can be drawn again, checked
and shared between machines without being stored. Class weights come from the draws of the tree at hand.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions import constants as C
from txnrisk.session import stage

MAX_BINS = 128
#: More draws of one row have a chance below 1e-12.
MOST_DRAWS = 14
FITS_AT_ONCE = 4


def draws(key: str | Column, tree: int | Column, seed: int = C.SEED) -> Column:
    """How often the row is in the tree's sample: where 52 bits of a hash lie among the Poisson distribution's steps."""
    return _steps(_share(key, tree, seed))


def all_draws(key: str | Column, trees: int, seed: int = C.SEED) -> Column:
    """``draws`` for each tree, in order, as an array of bytes: a hash for each tree."""
    shares = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: _share(key, tree, seed))
    return F.transform(shares, lambda share: _steps(share).cast("byte"))


def _share(key: str | Column, tree: int | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    tree = F.lit(tree) if isinstance(tree, int) else tree
    text = F.concat_ws(":", key.cast("string"), tree.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _steps(share: Column) -> Column:
    count, reached = F.lit(0), 0.0
    for k in range(MOST_DRAWS):
        reached += math.exp(-1.0) / math.factorial(k)
        count = count + F.when(share >= F.lit(reached), 1).otherwise(0)
    return count


def sample_sizes(rows: DataFrame, trees: int, label: str, key: str = "id", seed: int = C.SEED) -> DataFrame:
    """(tree, label, rows, draws): each tree's sample by class, in one pass."""
    drawn = (rows.select(F.col(label).alias("label"), key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
             .withColumn("k", draws(key, F.col("tree"), seed)))
    return drawn.groupBy("tree", "label").agg(F.count_if(F.col("k") > 0).alias("rows"), F.sum("k").alias("draws"))


@dataclass(frozen=True)
class BalancedForest:
    trees: Sequence[RandomForestClassificationModel]
    features: Sequence[str]

    def probabilities(self, df: DataFrame, out: str = "probability_of_fraud") -> DataFrame:
        """``df`` plus the mean of the trees' probabilities of class 1."""
        scored = VectorAssembler(inputCols=list(self.features), outputCol="_features").transform(df)
        total = F.lit(0.0)
        for i, tree in enumerate(self.trees):
            tree = tree.copy().setFeaturesCol("_features").setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
            scored = tree.transform(scored)
            total = total + vector_to_array(f"_p{i}")[1]
        return scored.select(*df.columns, (total / len(self.trees)).alias(out))


def fit_balanced_forest(train: DataFrame, trees: int = 100, label: str = "isFraud", key: str = "id",
                        features: Sequence[str] = tuple(C.MODEL_FEATURES), seed: int = C.SEED,
                        at_once: int = FITS_AT_ONCE) -> BalancedForest:
    """Depth 8, leaves of at least 10 rows, square-root feature subsets; ``at_once`` trees are fitted side by side.

    The driver holds one number per tree and class. Draws are worked out once for all trees and stored with the
    rows: a fit passes over its sample several times.
    """
    plain = train.select(F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features],
                         all_draws(key, trees, seed).alias("draws"))
    frame = stage(VectorAssembler(inputCols=list(features), outputCol="features").transform(plain).select("label", "features", "draws"), "forest-frame")
    sizes: dict[int, dict[float, int]] = {}
    drawn = frame.select("label", F.posexplode("draws").alias("tree", "k"))
    for r in drawn.groupBy("tree", "label").agg(F.sum("k").alias("draws")).collect():
        sizes.setdefault(r["tree"], {})[float(r["label"])] = r["draws"]

    def fit(tree: int) -> RandomForestClassificationModel:
        own = {c: n for c, n in sizes[tree].items() if n}
        weight = F.create_map(*[F.lit(x) for c, n in own.items() for x in (c, sum(own.values()) / (len(own) * n))])
        k = F.col("draws")[tree]
        sample = frame.where(k > 0).select("label", "features", (k * weight[F.col("label")]).alias("weight"))
        return RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=1, bootstrap=False, subsamplingRate=1.0, maxDepth=8, minInstancesPerNode=10,
            featureSubsetStrategy="sqrt", maxBins=MAX_BINS, seed=seed + tree).fit(sample)

    with ThreadPool(at_once) as pool:
        return BalancedForest(pool.map(fit, range(trees)), tuple(features))
