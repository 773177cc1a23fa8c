"""Validation around trained models: nested folds, selection, stress tests, synthetic positives."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import drift, models
from .ranking import average_precision_roc, divide, pearson, ranked_points, ranked_rows
from .similarity import euclidean, topk_in_blocks
from .splits import MODULUS, numbered, shuffle_hash

#: Limits of the robustness grades and of feature stability (fixed values).
GRADES = {"HIGH": (0.15, 0.06, 0.90, 0.30), "MEDIUM": (0.30, 0.12, 0.75, 0.50)}
SELECTION_MIN, IMPORTANCE_CV, MISSING_RANGE, PSI_MAX, PSI_WATCH = 0.40, 1.25, 0.15, 0.25, 0.10

#: Labelled rows that synthetic ones are drawn from at most.
MOST_POSITIVES = 20_000

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def _ap(scored: DataFrame) -> float:
    row = average_precision_roc(ranked_points(scored, []), []).first()
    return float(row["ap"]) if row and row["ap"] is not None else 0.0


def nested_scores(rows: DataFrame, features: list[str], candidates: dict[str, Scorer], settle, outer: int = 3, inner: int = 3) -> tuple[DataFrame, list[tuple[int, str, float]]]:
    """Outer out-of-fold scores, each fold by the candidate with the best inner AP; and (outer fold, candidate, inner AP).

    rows: row_index, target, features, fold (the outer one). Inner folds come from the row's hash,
    so no row of the outer fold takes part in a choice.
    """
    out, choices = None, []
    for f in range(outer):
        train = rows.where(F.col("fold") != f).withColumn("fold", (shuffle_hash(F.col("row_index"), 100 + f) % inner).cast("int"))
        trial = {name: _ap(models.out_of_fold(train, features, scorer, folds=inner)) for name, scorer in candidates.items()}
        best = max(sorted(trial), key=trial.get)
        choices += [(f, name, ap) for name, ap in trial.items()]
        both = train.withColumn("fold", F.lit(1)).unionByName(rows.where(F.col("fold") == f).withColumn("fold", F.lit(0)))
        part = settle(models.out_of_fold(both, features, candidates[best], folds=1))
        out = part if out is None else out.unionByName(part)
    return out, choices


def importances(rows: DataFrame, features: list[str], method: str = "l1", seed: int = 42) -> dict[str, float]:
    """Importance of each feature in one fit: |coefficient| of an L1 logistic regression on standardised columns, or tree gain."""
    plain = rows.select(F.col("target").cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(plain)
    if method == "l1":
        return {f: abs(float(c)) for f, c in zip(features, LogisticRegression(elasticNetParam=1.0, regParam=0.001, maxIter=50).fit(data).coefficients)}
    return dict(zip(features, map(float, GBTClassifier(maxIter=3, maxDepth=3, seed=seed).fit(data).featureImportances.toArray())))


def selection_frequencies(rows: DataFrame, features: list[str], subsamples: int = 8, share: float = 0.7, top: int = 3, method: str = "l1") -> DataFrame:
    """(feature, frequency, mean_rank, mean_importance, importance_cv) over hash-chosen subsamples; mean_rank over the subsamples alone."""
    seen = []
    for s in range(subsamples):
        sample = rows.where(shuffle_hash(F.col("row_index"), 1000 + s) < int(share * MODULUS))
        own = importances(sample, features, method)
        order = sorted(features, key=lambda f: (-own[f], f))
        total = sum(own.values()) or 1.0
        seen += [(f, own[f] / total, order.index(f) + 1) for f in features]
    spark = rows.sparkSession
    long = spark.createDataFrame(seen, "feature string, importance double, rank int")
    mean = F.avg("importance")
    return long.groupBy("feature").agg(F.avg((F.col("rank") <= top).cast("double")).alias("frequency"), F.avg("rank").alias("mean_rank"), mean.alias("mean_importance"), F.coalesce(divide(F.stddev_pop("importance"), mean), F.lit(0.0)).alias("importance_cv"))


def selection_optimism(rows: DataFrame, features: list[str], scorer: Scorer, k: int, folds: int = 5) -> DataFrame:
    """One row (ap_selected_once, ap_selected_in_fold, optimism): AP with the k best features chosen on all rows, and chosen anew on the training rows of each fold."""
    best = lambda own: sorted(features, key=lambda f: (-own[f], f))[:k]
    once = _ap(models.out_of_fold(rows, best(importances(rows, features)), scorer, folds=folds))
    inside = None
    for f in range(folds):
        chosen = best(importances(rows.where(F.col("fold") != f), features))
        both = rows.withColumn("fold", F.when(F.col("fold") == f, 0).otherwise(1))
        part = models.out_of_fold(both, chosen, scorer, folds=1)
        inside = part if inside is None else inside.unionByName(part)
    own = _ap(inside)
    return rows.sparkSession.createDataFrame([(once, own, once - own)], "ap_selected_once double, ap_selected_in_fold double, optimism double")


def top_features(frequencies: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k most frequent features, at least `least` frequent, ties by name."""
    return frequencies.where(F.col("frequency") >= least).orderBy(F.col("frequency").desc(), "feature").limit(k)


def rank_agreement(long: DataFrame, run: str, item: str, value: str, top: int) -> DataFrame:
    """(run_a, run_b, spearman, overlap): agreement of runs in how they rank items, and of their top sets."""
    order = Window.partitionBy(run).orderBy(F.col(value).desc(), item)  # items are columns or models
    ranked = long.select(F.col(run).alias("run"), F.col(item).alias("item"), F.row_number().over(order).cast("double").alias("r"))
    both = ranked.toDF("run_a", "item", "ra").join(ranked.toDF("run_b", "item", "rb"), "item").where("run_a < run_b")
    hit = F.count_if((F.col("ra") <= top) & (F.col("rb") <= top))
    return both.groupBy("run_a", "run_b").agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"), (hit / float(top)).alias("overlap"))


def feature_stability(long: DataFrame, folds: int, frequencies: DataFrame, forbidden: list[str] = ()) -> DataFrame:
    """(feature, psi_max, missing_range, frequency, flag): STABLE, WATCH, SHIFT_PRONE or LEAKAGE from fold to fold.

    long: (feature, value, fold). Each fold is compared with the others in one pass.
    """
    each = long.withColumn("held", F.explode(F.array(*(F.lit(f) for f in range(folds)))))
    sided = each.select(F.concat_ws("|", "feature", "held").alias("feature"), "value", (F.col("fold") != F.col("held")).alias("is_reference"))
    psi = drift.psi_closed(sided).select(F.substring_index("feature", "|", 1).alias("feature"), "psi").groupBy("feature").agg(F.max("psi").alias("psi_max"))
    gaps = long.groupBy("feature", "fold").agg(F.avg(F.col("value").isNull().cast("double")).alias("m")).groupBy("feature").agg((F.max("m") - F.min("m")).alias("missing_range"))
    rows = psi.join(gaps, "feature").join(frequencies.select("feature", "frequency", "importance_cv"), "feature", "left")
    shifted = (F.col("psi_max") > PSI_MAX) | (F.col("missing_range") > MISSING_RANGE)
    watch = (F.coalesce("frequency", F.lit(0.0)) < SELECTION_MIN) | (F.col("psi_max") > PSI_WATCH) | (F.coalesce("importance_cv", F.lit(0.0)) > IMPORTANCE_CV)
    leak = F.col("feature").isin(*forbidden) if forbidden else F.lit(False)
    flag = F.when(leak, "LEAKAGE").when(shifted, "SHIFT_PRONE").when(watch, "WATCH").otherwise("STABLE")
    return rows.select("feature", "psi_max", "missing_range", "frequency", flag.alias("flag"))


def positive_removal(rows: DataFrame, features: list[str], scorer: Scorer, rounds: int = 3, share: float = 0.2, folds: int = 2) -> DataFrame:
    """(round, ap, relative_drop, steady): AP with a hash-chosen share of the positives left out of training, against round 0 with all, and the rank correlation of its scores with round 0's."""
    got, first = [], None
    for r in range(rounds + 1):
        gone = (F.col("target") == 1) & (shuffle_hash(F.col("row_index"), 500 + r) < int(share * MODULUS)) & F.lit(r > 0)
        folded = rows.withColumn("fold", (shuffle_hash(F.col("row_index"), 77) % folds).cast("int"))
        part = None
        for f in range(folds):
            train = folded.where((F.col("fold") != f) & ~gone).withColumn("fold", F.lit(1))
            held = models.out_of_fold(train.unionByName(folded.where(F.col("fold") == f).withColumn("fold", F.lit(0))), features, scorer, folds=1)
            part = held if part is None else part.unionByName(held)
        ranked = ranked_rows(part.withColumn("k", F.lit(1)), ["k"]).select("row_index", F.col("rn").cast("double").alias(f"r{r}"))
        first = ranked if first is None else first
        steady = 1.0 if r == 0 else first.join(ranked, "row_index").agg(pearson(F.col("r0"), F.col(f"r{r}")).alias("c")).first()["c"]
        got.append((r, _ap(part), steady))
    base = got[0][1] or 1.0
    return rows.sparkSession.createDataFrame([(r, ap, (base - ap) / base, None if c is None else float(c)) for r, ap, c in got], "round int, ap double, relative_drop double, steady double")


def family_dropout(rows: DataFrame, families: dict[str, list[str]], scorer: Scorer, folds: int = 2) -> DataFrame:
    """(family, ap, relative_drop): AP without each family of features; '' is with all."""
    folded = rows.withColumn("fold", (shuffle_hash(F.col("row_index"), 77) % folds).cast("int"))
    every = [c for own in families.values() for c in own]
    got = {"": _ap(models.out_of_fold(folded, every, scorer, folds=folds))}
    got |= {name: _ap(models.out_of_fold(folded, [c for c in every if c not in own], scorer, folds=folds)) for name, own in families.items() if len(own) < len(every)}
    base = got[""] or 1.0
    return rows.sparkSession.createDataFrame([(n, ap, (base - ap) / base) for n, ap in got.items()], "family string, ap double, relative_drop double")


def robustness_grades(measured: DataFrame) -> DataFrame:
    """measured (relative_drop, spread, steady) with grade: HIGH, MEDIUM or LOW, the worst of the criteria; a missing one isn't met."""
    c, grade = F.col, F.lit("LOW")
    for name, (drop, spread, steady, _) in reversed(GRADES.items()):
        grade = F.when((c("relative_drop") <= drop) & (c("spread") <= spread) & (c("steady") >= steady), name).otherwise(grade)
    return measured.withColumn("grade", grade)


def smote(rows: DataFrame, features: list[str], ratio: float, k: int = 5, seed: int = 0, key: str = "row_index", target: str = "target", most_positives: int = MOST_POSITIVES) -> DataFrame:
    """(key, neighbour, features...) of synthetic positives between positives and their near positives, until they are `ratio` of the negatives.

    Distances are taken on standardised columns with gaps at the mean; a coordinate that one parent
    lacks stays missing. Parents, neighbours and gaps come from a hash. Fewer than two positives give none.
    Parents are taken from most_positives labelled rows at most, the first in hash order: the search among
    them is bounded whatever the table's size.
    """
    pos = rows.where(F.col(target) == 1).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most_positives)
    sums = pos.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    every = rows.agg(F.count_if(F.col(target) == 0).alias("q"), F.count_if(F.col(target) == 1).alias("p")).first()
    n_pos, n_new = sums["n"], max(0, round(ratio * every["q"]) - every["p"])
    z = [F.coalesce((F.col(c) - F.lit(sums[f"m_{c}"])) / F.lit(sums[f"s_{c}"] if sums[f"s_{c}"] and sums[f"s_{c}"] > 1e-12 else 1.0), F.lit(0.0)) for c in features]
    points = pos.select(F.col(key).cast("bigint").alias("row"), F.array(*z).alias("v"))
    near = topk_in_blocks(points, points, min(k, max(1, n_pos - 1)), euclidean).select("query", "row", "rank")
    placed = numbered(pos.withColumn("__h", shuffle_hash(F.col(key), seed)), [], "__h", key).select(key, F.col("before").alias("place"), *features)
    new = rows.sparkSession.range(n_new if n_pos > 1 else 0).select(
        "id", (shuffle_hash(F.col("id"), seed + 1) % max(1, n_pos)).alias("place"), (shuffle_hash(F.col("id"), seed + 2) % min(k, max(1, n_pos - 1)) + 1).alias("rank"), ((shuffle_hash(F.col("id"), seed + 3) + 0.5) / MODULUS).alias("gap")
    )
    a = new.join(placed, "place").withColumnsRenamed({c: f"a_{c}" for c in features})
    b = a.join(near.withColumnRenamed("query", key), [key, "rank"]).join(pos.select(F.col(key).alias("row"), *(F.col(c).alias(f"b_{c}") for c in features)), "row")
    return b.select("id", key, F.col("row").alias("neighbour"), *((F.col(f"a_{c}") + F.col("gap") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in features))


def empirical_p(drawn: DataFrame, observed: float, figure: str = "modal_share") -> DataFrame:
    """One row (n_draws, n_as_high, p): one-sided, (1 + draws at least as high) / (1 + draws)."""
    high = F.count_if(F.col(figure) >= F.lit(observed))
    return drawn.agg(F.count(F.lit(1)).alias("n_draws"), high.alias("n_as_high"), ((high + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def concentration_control(values: DataFrame, n_rows: int, draws: int, key: str = "row_index", value: str = "value") -> DataFrame:
    """(draw, n_distinct, modal_share) of hash-chosen draws of about n_rows rows: how concentrated chance alone is."""
    total = max(1, values.count())
    cut = max(1, int(n_rows / total * MODULUS))
    hashed = shuffle_hash(F.col(key), F.col("draw") + 9000)
    drawn = values.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).where(hashed < cut)
    counts = drawn.groupBy("draw", value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("draw").agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("modal_share"))


def linear_contributions(train: DataFrame, rows: DataFrame, features: list[str], key: str = "row_index") -> DataFrame:
    """(key, feature, value, contribution): coefficient * (value - training mean) of a logistic regression, its exact additive attribution."""
    filled = lambda df: df.select(*([key] if key in df.columns else []), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    labelled = train.select(F.col("target").cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    model = LogisticRegression(regParam=0.01, maxIter=50).fit(VectorAssembler(inputCols=features, outputCol="features").transform(labelled))
    means = labelled.agg(*(F.avg(c).alias(c) for c in features)).first()
    weight = {c: float(w) for c, w in zip(features, np.asarray(model.coefficients))}
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), (F.lit(weight[c]) * (F.col(c) - F.lit(float(means[c])))).alias("contribution")) for c in features))
    return filled(rows).select(key, F.explode(parts).alias("p")).select(key, "p.*")
