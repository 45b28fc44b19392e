"""Gradient-boosted trees trained on all labelled rows and applied as one SQL expression."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: Of each class, this many rows are needed for a model.
LEAST_OF_CLASS = 10
#: Bins of a feature, rows up to which the learner looks at all of them with so few bins, and the most bins.
BINS, FEW_ROWS, MOST_BINS = 32, 10_000, 46_340


@dataclass(frozen=True)
class Trees:
    """Per tree its weight and root; a node is a number, or (feature, threshold, left, right)."""

    features: tuple[str, ...]
    trees: tuple[tuple[float, object], ...]

    def probability(self, feature: Callable[[str], Column]) -> Column:
        """Probability of the label 1, from the columns that ``feature`` gives."""
        margin = sum((weight * self._value(node, feature) for weight, node in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def _value(self, node: object, feature: Callable[[str], Column]) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        index, threshold, left, right = node
        return F.when(feature(self.features[index]) <= threshold, self._value(left, feature)).otherwise(self._value(right, feature))


def train(rows: DataFrame, features: list[str], label: str = "label", *, rounds: int = 12, depth: int = 3, seed: int = 7) -> Trees | None:
    """Trees for all rows with numeric features and a label of 0 or 1; None if a class is too rare.

    Equal rows are learned as one with their number as its weight. With more distinct ones, bins
    are as many as make the learner read all rows for its thresholds too (their square root).
    """
    named = rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_label"))
    distinct = named.groupBy("_label", *features).agg(F.count("*").cast("double").alias("_weight"))
    distinct = written(distinct.sortWithinPartitions("_label", *features), "labelled")
    counts = {int(r[0]): (r[1], r[2]) for r in distinct.groupBy("_label").agg(F.sum("_weight"), F.count("*")).collect()}
    if min(counts.get(k, (0, 0))[0] for k in (0, 1)) < LEAST_OF_CLASS:
        return None
    n = sum(c for _, c in counts.values())
    bins = BINS if n <= FEW_ROWS else min(MOST_BINS, math.ceil(math.sqrt(n)))
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(distinct).select("_features", "_label", "_weight")
    learner = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=seed, checkpointInterval=-1)
    model = learner.fit(vectors)
    return Trees(tuple(features), tuple((w, _node(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)))


def _node(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _node(node.leftChild()), _node(node.rightChild())


def calibrated(held_out: DataFrame, group: Column, probability: Column, label: Column, precision: float) -> dict[str, float]:
    """For each group the least threshold, in hundredths, from which on held-out rows reach the precision; groups that never do are left out."""
    steps = held_out.groupBy(group.alias("g"), F.floor(probability * 100).cast("int").alias("p")).agg(F.sum(label.cast("int")).alias("hit"), F.count("*").alias("n")).collect()
    out: dict[str, float] = {}
    for name in {r.g for r in steps}:
        hit = n = 0
        for r in sorted((r for r in steps if r.g == name), key=lambda r: -r.p):
            hit, n = hit + r.hit, n + r.n
            if hit < precision * n:
                break
            out[name] = r.p / 100
    return out
