"""Boosted trees and isotonic calibration: fitted on bounded samples by Spark ML, applied as SQL expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tree is a number or (feature, threshold, tree if not above, tree if above).
Tree = float | tuple


def sampled(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids, chosen by their hash: doc_id and label. Of several labels of an id the largest counts."""
    return (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def fit(rows: DataFrame, features: Sequence[str], rounds: int = 15, depth: int = 3) -> list[tuple[float, Tree]]:
    """Weighted trees for column ``label``; none where only one label occurs."""
    seen = rows.agg(F.count_distinct("label")).first()[0]
    if seen < 2:
        return []
    held = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("label", "features")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, minInstancesPerNode=2,
                          maxMemoryInMB=64).fit(held)
    return [(w, parse(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)]


def parse(text: str) -> Tree:
    """The tree that Spark ML prints as nested If and Else lines."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def take() -> Tree:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = take()
        lines.pop(0)  # Else
        return int(feature), float(threshold), low, take()

    return take()


def margin(trees: list[tuple[float, Tree]], value: Callable[[int], Column]) -> Column:
    def of(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, low, high = tree
        return F.when(value(feature) <= threshold, of(low)).otherwise(of(high))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + F.lit(weight) * of(tree)
    return total


def probability(trees: list[tuple[float, Tree]], value: Callable[[int], Column]) -> Column:
    return 1 / (1 + F.exp(-2 * margin(trees, value)))


def calibration(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Isotonic regression of ``label`` on ``raw``: bounds and values, at most a hundred steps."""
    model = IsotonicRegression(featuresCol="raw", labelCol="label").fit(
        rows.select(F.round("raw", 2).alias("raw"), "label"))
    return model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()


def calibrated(raw: Column, steps: tuple[list[float], list[float]]) -> Column:
    """Linear between the bounds, level beyond them."""
    bounds, values = steps
    out = F.lit(values[-1])
    for i in reversed(range(len(bounds))):
        if i == 0:
            out = F.when(raw <= bounds[0], F.lit(values[0])).otherwise(out)
        elif bounds[i] > bounds[i - 1]:
            share = (raw - bounds[i - 1]) / (bounds[i] - bounds[i - 1])
            out = F.when(raw <= bounds[i], values[i - 1] + share * (values[i] - values[i - 1])).otherwise(out)
    return out
