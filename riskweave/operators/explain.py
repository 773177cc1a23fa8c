"""What moves a score: exact Shapley values of boosted trees, counterfactuals, global importance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import divide

#: Features a tree may use at most: its subsets are all looked at (trees of depth three use seven).
TREE_FEATURES = 12
#: Raising features that a counterfactual moves (fixed value).
MOVED = 3


def exported_trees(model: GBTClassificationModel) -> list[tuple[float, tuple]]:
    """(weight, tree) of a boosted model; a tree is (feature, threshold, left, right, n) or (value, n) at a leaf."""

    def read(node) -> tuple:
        n = float(node.impurityStats().rawCount())
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction()), n
        return int(node.split().featureIndex()), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild()), n

    return [(float(w), read(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]


def _used(tree: tuple) -> set[int]:
    return set() if len(tree) == 2 else {tree[0]} | _used(tree[2]) | _used(tree[3])


def _expected(tree: tuple, x: np.ndarray, known: frozenset) -> np.ndarray:
    """Value of a tree where only the known features are given: unknown splits average their sides by the training rows."""
    if len(tree) == 2:
        return np.full(len(x), tree[0])
    feature, threshold, left, right, _ = tree
    low, high = _expected(left, x, known), _expected(right, x, known)
    if feature in known:
        return np.where(x[:, feature] <= threshold, low, high)
    return (low * left[-1] + high * right[-1]) / (left[-1] + right[-1])


def shapley_of_trees(trees: list[tuple[float, tuple]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features) Shapley values of the weighted sum of trees, and its value with nothing known."""
    out, base = np.zeros(x.shape), 0.0
    for weight, tree in trees:
        used = sorted(_used(tree))
        if len(used) > TREE_FEATURES:
            raise ValueError(f"a tree of more than {TREE_FEATURES} features")
        m = len(used)
        worth = {frozenset(s): weight * _expected(tree, x, frozenset(s)) for k in range(m + 1) for s in combinations(used, k)}
        base += float(worth[frozenset()][0]) if len(x) else 0.0
        for own, value in worth.items():
            share = factorial(len(own)) * factorial(m - len(own) - 1) / factorial(m) if len(own) < m else 0.0
            for f in used:
                if f not in own:
                    out[:, f] += share * (worth[own | {f}] - value)
    return out, base


def tree_contributions(model: GBTClassificationModel, rows: DataFrame, features: list[str], key: str = "row_index") -> DataFrame:
    """(key, feature, value, contribution): exact Shapley values on the margin, which add up to it from the model's mean margin.

    Rows are looked at where they lie, all subsets of a tree's features at once for a whole batch.
    Missing values count as 0, as in the fit.
    """
    trees = [(2 * w, t) for w, t in exported_trees(model)]  # the margin is twice the sum of the trees
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))])
            got, _ = shapley_of_trees(trees, x)
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(n), len(features))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(features * n), pa.array(x.ravel()), pa.array(got.ravel())], names=[key, "feature", "value", "contribution"])

    plain = rows.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)))
    return plain.mapInArrow(run, f"{key} {kind}, feature string, value double, contribution double")


def global_importance(contributions: DataFrame) -> DataFrame:
    """(feature, mean_abs, share, place) over all rows, the strongest first."""
    means = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    every, order = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("mean_abs").desc(), "feature")  # one row a feature
    return means.select("feature", "mean_abs", F.coalesce(divide(F.col("mean_abs"), F.sum("mean_abs").over(every)), F.lit(0.0)).alias("share"), F.row_number().over(order).alias("place"))


def counterfactuals(rows: DataFrame, weights: dict[str, float], intercept: float, medians: dict[str, float], threshold: float, moved: int = MOVED, key: str = "row_index") -> DataFrame:
    """(key, step, feature, score, is_below): the score after moving the strongest raising features to the legitimate median, one after the other.

    The score is a logistic model of the given weights. A feature raises a score if its weighted distance
    from the median is above 0; ties go by name. Step 0 is the row as it is (no feature). Missing values count as
    the median. All is one projection; nothing is shuffled.
    """
    gap = [F.struct((-(F.lit(w) * (F.coalesce(F.col(f).cast("double"), F.lit(medians[f])) - medians[f]))).alias("k"), F.lit(f).alias("feature")) for f, w in sorted(weights.items())]
    z = F.lit(intercept)
    for f, w in sorted(weights.items()):
        z = z + F.lit(w) * F.coalesce(F.col(f).cast("double"), F.lit(medians[f]))
    raising = F.slice(F.array_sort(F.filter(F.array(*gap), lambda g: g["k"] < 0)), 1, moved)
    ready = rows.select(key, z.alias("z"), raising.alias("raising"))
    steps = F.concat(F.array(F.struct(F.lit(0).alias("step"), F.lit(None).cast("string").alias("feature"))), F.transform("raising", lambda g, i: F.struct((i + 1).alias("step"), g["feature"].alias("feature"))))
    each = ready.select(key, "z", "raising", F.explode(steps).alias("s"))
    after = F.col("z") + F.aggregate(F.slice("raising", 1, F.col("s.step")), F.lit(0.0), lambda a, g: a + g["k"])
    score = 1 / (1 + F.exp(-after))
    return each.select(key, "s.step", "s.feature", score.alias("score"), (score < threshold).alias("is_below"))

