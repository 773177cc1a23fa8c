"""Models trained here: calibrators, out-of-fold scoring, separability, isolation forest.

Classifiers are Spark ML's (gradient boosted trees and logistic regression); they
stand for the boosting libraries of the system this covers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import average_precision_roc, ranked_points
from .splits import MODULUS, shuffle_hash

#: Boosting rounds.
ROUNDS = 20
#: Isolation forest: trees, and rows a tree is grown on (a bound whatever the input's size).
TREES, TREE_ROWS = 100, 256


def logit(p: Column, eps: float = 1e-7) -> Column:
    """Log odds of a probability kept eps from its ends."""
    inside = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(inside / (1 - inside))


def platt_fit(rows: DataFrame, score: str = "score", target: str = "target") -> tuple[float, float]:
    """Slope and intercept of an unregularised logistic regression on the scores' log odds."""
    data = VectorAssembler(inputCols=["z"], outputCol="x").transform(rows.select(logit(F.col(score)).alias("z"), F.col(target).cast("double").alias("label")))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.0, maxIter=100, standardization=False).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def platt_apply(score: Column, a: float, b: float) -> Column:
    """Calibrated probability."""
    return 1 / (1 + F.exp(-(a * logit(score) + b)))


def isotonic_apply(rows: DataFrame, train: DataFrame, score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """The rows with calibrated, by isotonic regression on train, within 0..1; weight: how often a row of train counts."""
    fit = VectorAssembler(inputCols=[score], outputCol="__x")
    many = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    learner = IsotonicRegression(featuresCol="__x", labelCol="label", predictionCol="calibrated", weightCol="weight")
    model = learner.fit(fit.transform(train.select(score, F.col(target).cast("double").alias("label"), many.alias("weight"))))
    return model.transform(fit.transform(rows)).drop("__x").withColumn("calibrated", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))


def cross_fitted(rows: DataFrame, method: str, fold: str = "fold", folds: int = 5, score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """The rows with calibrated: each fold by a calibrator of the others; weight, how often a row counts, is for isotonic."""
    out = None
    for f in range(folds):
        train, held = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        if method == "platt":
            part = held.withColumn("calibrated", platt_apply(F.col(score), *platt_fit(train, score, target)))
        else:
            part = isotonic_apply(held, train, score, target, weight)
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(rows: DataFrame, features: list[str], scorer: Callable[[DataFrame, DataFrame], DataFrame], fold: str = "fold", folds: int = 5) -> DataFrame:
    """(row_index, target, score): every row scored by a model of the other folds.

    scorer(train, held) gets rows with a features vector, the label and weight, and returns held
    with score. Missing values are filled with 0 after a flag column for each.
    """
    flags = [F.col(c).isNull().cast("double").alias(f"__m_{c}") for c in features]
    plain = rows.select("row_index", "target", fold, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), *flags)
    ready = VectorAssembler(inputCols=[*features, *(f"__m_{c}" for c in features)], outputCol="features").transform(plain).select("row_index", "target", fold, "features", F.col("target").cast("double").alias("label"))
    out = None
    for f in range(folds):
        train = ready.where(F.col(fold) != f)
        n = train.agg(F.avg("label").alias("p")).first()["p"] or 0.0
        weighted = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(min(50.0, (1 - n) / n) if n else 1.0)).otherwise(1.0))
        part = scorer(weighted, ready.where(F.col(fold) == f)).select("row_index", "target", "score")
        out = part if out is None else out.unionByName(part)
    return out


def boosted_trees(train: DataFrame, held: DataFrame, rounds: int = ROUNDS, depth: int = 3, seed: int = 42, validation: float = 0.0) -> DataFrame:
    """Scorer: gradient boosted trees with balanced weights; with a validation share, boosting stops when a hash-chosen part of the rows no longer gains."""
    model = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
    if validation:
        model = model.setValidationIndicatorCol("is_validation")
        train = train.withColumn("is_validation", shuffle_hash(F.col("row_index"), seed) < int(validation * MODULUS))
    return model.fit(train).transform(held).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def logistic(train: DataFrame, held: DataFrame, l1: float = 0.0, reg: float = 0.01) -> DataFrame:
    """Scorer: logistic regression with balanced weights, L1 share l1."""
    model = LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", regParam=reg, elasticNetParam=l1, maxIter=50).fit(train)
    return model.transform(held).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def prevalence(train: DataFrame, held: DataFrame) -> DataFrame:
    """Scorer: the training share of positives for all."""
    return held.withColumn("score", F.lit(train.agg(F.avg("label").alias("p")).first()["p"] or 0.0))


def separability(reference: DataFrame, current: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """One row (auc, band): how well a model tells the two loads apart; NONE under 0.60, WEAK under 0.75, STRONG under 0.90, else SEVERE."""
    both = reference.withColumn("target", F.lit(0)).unionByName(current.withColumn("target", F.lit(1)))
    folded = both.withColumn("fold", (shuffle_hash(F.col("row_index"), 11) % folds).cast("int"))
    auc = average_precision_roc(ranked_points(out_of_fold(folded, features, logistic, folds=folds), []), []).select(F.col("roc_auc").alias("auc"))
    return auc.withColumn("band", F.when(F.col("auc") < 0.60, "NONE").when(F.col("auc") < 0.75, "WEAK").when(F.col("auc") < 0.90, "STRONG").otherwise("SEVERE"))


def _expected_depth(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int, most: int):
    if depth >= most or len(points) < 2:
        return depth + _expected_depth(len(points))
    low, high = points.min(0), points.max(0)
    open_ = np.nonzero(high > low)[0]
    if not len(open_):
        return depth + _expected_depth(len(points))
    dim = int(rng.choice(open_))
    cut = float(rng.uniform(low[dim], high[dim]))
    left = points[:, dim] < cut
    return dim, cut, _grow(points[left], rng, depth + 1, most), _grow(points[~left], rng, depth + 1, most)


def _depths(tree, points: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(points), tree)
    dim, cut, low, high = tree
    out, left = np.empty(len(points)), points[:, dim] < cut
    out[left], out[~left] = _depths(low, points[left]), _depths(high, points[~left])
    return out


def isolation_forest(rows: DataFrame, features: list[str], fit_on: DataFrame, key: str = "row_index", trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42) -> DataFrame:
    """(key, anomaly): 0..1, near 1 for rows that few cuts isolate.

    Trees grow on hash-chosen rows of fit_on, trees * tree_rows at most (a bound); every row is
    scored. Missing values count as 0.
    """
    plain = lambda df: df.select(key, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).alias("v"))
    sample = np.array([r["v"] for r in plain(fit_on).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(min(20_000, trees * tree_rows)).select("v").collect()])
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(sample))
    forest = [_grow(sample[rng.choice(len(sample), size, replace=False)], rng, 0, int(np.ceil(np.log2(max(2, size))))) for _ in range(trees)] if size else []
    scale = _expected_depth(size) or 1.0
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, len(features))
            depth = np.mean([_depths(t, points) for t in forest], axis=0) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(2.0 ** (-depth / scale))], names=[key, "anomaly"])

    return plain(rows).mapInArrow(run, f"{key} {kind}, anomaly double")
