"""Joining models: logistic fits of many groups at once, calibrator choice, stacking, acceptance, seed bagging."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import logit
from .ranking import average_precision_roc, divide, ranked_points

#: A calibrator replaces another if it improves Brier and ECE by at least this share (fixed value).
IMPROVEMENT = 0.02
#: Newton steps at most, and the step from which on a fit has settled.
STEPS, SETTLED = 25, 1e-10
#: A blend is accepted with at least so much mean gain, no loss in so large a share of the repeats, and no larger worst loss (fixed values).
LEAST_GAIN, LEAST_WINS, WORST_LOSS = 0.0, 0.6, 0.01


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))


def fit_logistics(points: DataFrame, keys: list[str], features: list[str], ridge: float = 1e-6, balanced: bool = False, target: str = "target", n: str | None = None) -> DataFrame:
    """(keys, w array<double>): intercept and weights of a logistic regression for every group, all groups in the same scans.

    Newton's method: a step needs one aggregate of the gradient and the second derivatives, a few
    numbers a group, whatever the number of rows; groups are models, repeats or folds, so few. ridge
    is the penalty of the weights, not of the intercept; balanced gives both classes the same weight;
    n: a column of how often a row counts. Groups without both classes have no row. Null features
    leave a row out.
    """
    size = len(features) + 1
    many = F.lit(1.0) if n is None else F.col(n).cast("double")
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(1, size))]
    rows = points.select(*keys, F.col(target).cast("double").alias("y"), many.alias("n"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features, 1))).dropna(subset=["y", *(f"x{i}" for i in range(1, size))])
    sums = rows.groupBy(*keys).agg(F.sum(F.col("n") * F.col("y")).alias("p"), F.sum(F.col("n") * (1 - F.col("y"))).alias("q")).where("p > 0 AND q > 0").collect()
    spark = points.sparkSession
    kinds = [points.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"`__{k}` {t}" for k, t in zip(keys, kinds)), "w array<double>", "cp double", "cq double"])
    groups = [tuple(r[k] for k in keys) for r in sums]
    weights = np.zeros((len(groups), size))
    ratio = [((r["p"] + r["q"]) / 2 / r["p"], (r["p"] + r["q"]) / 2 / r["q"]) if balanced else (1.0, 1.0) for r in sums]
    place = {g: i for i, g in enumerate(groups)}
    for _ in range(STEPS if groups else 0):
        params = spark.createDataFrame([(*g, w.tolist(), *map(float, c)) for g, w, c in zip(groups, weights, ratio)], schema)
        z = reduce(Column.__add__, [F.col("w")[i] * x[i] for i in range(size)])
        own = rows.join(F.broadcast(params), _same(keys)).withColumn("f", 1 / (1 + F.exp(-z))).withColumn("c", F.col("n") * F.when(F.col("y") == 1, F.col("cp")).otherwise(F.col("cq")))  # one row a group
        cells = [F.sum(F.col("c") * (F.col("y") - F.col("f")) * x[i]).alias(f"g{i}") for i in range(size)]
        cells += [F.sum(F.col("c") * F.col("f") * (1 - F.col("f")) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)]
        largest = 0.0
        for r in own.groupBy(*keys).agg(*cells).collect():
            i = place[tuple(r[k] for k in keys)]
            penalty = np.diag([0.0, *[ridge] * (size - 1)])
            curve = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)]) + penalty
            step = np.linalg.lstsq(curve + 1e-12 * np.eye(size), np.array([r[f"g{a}"] for a in range(size)]) - penalty @ weights[i], rcond=None)[0]
            weights[i] += np.clip(step, -10, 10)
            largest = max(largest, float(np.abs(step).max()))
        if largest < SETTLED:
            break
    out = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "w array<double>"])
    return spark.createDataFrame([(*g, w.tolist()) for g, w in zip(groups, weights)], out)


def predict_logistics(rows: DataFrame, fits: DataFrame, keys: list[str], features: list[str], name: str = "score") -> DataFrame:
    """The rows with their group's prediction; null where the group has no fit or a feature is null."""
    named = fits.withColumnsRenamed({k: f"__{k}" for k in keys})
    z = reduce(Column.__add__, [F.col("w")[0], *(F.col("w")[i] * F.col(f) for i, f in enumerate(features, 1))])
    return rows.join(F.broadcast(named), _same(keys), "left").withColumn(name, 1 / (1 + F.exp(-z))).drop("w", *(f"__{k}" for k in keys))  # one row a group


def platt_fits(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target", weight: str | None = None, settle=lambda df: df) -> DataFrame:
    """(keys, a, b): slope and intercept on the log odds of the scores, of every group; equal rows are counted first.

    weight: how often a row counts. settle stores the counts, which every step of the fit reads.
    """
    points = settle(rows.groupBy(*keys, score, target).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")).withColumn("z", logit(F.col(score))))
    return fit_logistics(points, keys, ["z"], target=target, n="n").select(*keys, F.col("w")[1].alias("a"), F.col("w")[0].alias("b"))


def out_of_fold_logistics(rows: DataFrame, keys: list[str], features: list[str], folds: int, ridge: float = 1.0, balanced: bool = True, fold: str = "fold") -> DataFrame:
    """The rows with stacked: each fold predicted by a fit of the others; every fold of every group is fit in the same scans."""
    spread = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("held") != F.col(fold))
    fits = fit_logistics(spread, [*keys, "held"], features, ridge, balanced).withColumnRenamed("held", fold)
    return predict_logistics(rows, fits, [*keys, fold], features, "stacked")


def choose_calibrator(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chosen, brier_gain, ece_gain): isotonic only if it improves both Brier score and ECE on Platt's by IMPROVEMENT.

    comparison: (keys, method, brier, ece) with the methods platt and isotonic.
    """
    of = lambda method, metric: F.max(F.when(F.col("method") == method, F.col(metric)))
    gain = lambda metric: divide(of("platt", metric) - of("isotonic", metric), of("platt", metric)).alias(f"{metric}_gain")
    both = comparison.groupBy(*keys).agg(gain("brier"), gain("ece"))
    better = F.coalesce((F.col("brier_gain") >= IMPROVEMENT) & (F.col("ece_gain") >= IMPROVEMENT), F.lit(False))
    return both.select(*keys, F.when(better, "isotonic").otherwise("platt").alias("chosen"), "brier_gain", "ece_gain")


def blend_acceptance(blends: DataFrame, singles: DataFrame, names: list[str], rep: str = "rep", target: str = "target") -> DataFrame:
    """(blend, n_repeats, mean_gain, wins, worst_gain, is_accepted): every blend against the best single model of each repeat.

    blends: (rep, row, target, one column a blend); singles: (rep, ap) of the models.
    """
    best = singles.groupBy(rep).agg(F.max("ap").alias("best"))
    long = blends.unpivot([rep, target], names, "blend", "score")
    ap = average_precision_roc(ranked_points(long, ["blend", rep], "score", target), ["blend", rep]).select("blend", rep, "ap")
    gained = ap.join(best, rep).withColumn("gain", F.col("ap") - F.col("best"))
    sums = gained.groupBy("blend").agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") >= 0).cast("double")).alias("wins"), F.min("gain").alias("worst_gain"))
    accepted = (F.col("mean_gain") > LEAST_GAIN) & (F.col("wins") >= LEAST_WINS) & (F.col("worst_gain") >= -WORST_LOSS)
    return sums.withColumn("is_accepted", accepted)


def seed_bag(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_seeds, mean_score, mean_rank, sd): a row's scores and percentile ranks over the seeds of one configuration.

    ranked: keys, score and pct_rank, a row for each seed.
    """
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("score").alias("mean_score"), F.avg("pct_rank").alias("mean_rank"), F.stddev_pop("score").alias("sd"))


def best_of_pool(ranks: DataFrame, pools: dict[str, list[str]], n: int, order: list[str]) -> DataFrame:
    """(pool, place, feature): the n best features of each pool by mean rank, filled up in column order where a pool has fewer ranked ones.

    ranks: (feature, rank), one row or more a feature; a column the ranks don't name comes after all that they do.
    """
    spark = ranks.sparkSession
    named = spark.createDataFrame([(p, f, order.index(f)) for p, own in pools.items() for f in own], "pool string, feature string, at int")
    mean = ranks.groupBy("feature").agg(F.avg("rank").alias("mean_rank"))
    place = F.row_number().over(Window.partitionBy("pool").orderBy(F.col("mean_rank").asc_nulls_last(), "at"))  # columns, not rows
    return named.join(mean, "feature", "left").withColumn("place", place).where(F.col("place") <= n).select("pool", "place", "feature")
