"""Row-wise decisions on scores: conformal sets, tiers, blends, agreement, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import divide, ordinal_percentile, ranked_points

#: Miscoverage of the conformal sets (fixed value).
ALPHA = 0.10


def conformal_quantiles(rows: DataFrame, keys: list[str], alpha: float = ALPHA, score: str = "score", target: str = "target") -> DataFrame:
    """(keys, q_pos, q_neg): per class the ceil((n+1)(1-alpha))-th smallest nonconformity, at most the n-th; 1.0 for an empty class.

    Nonconformity is 1 - p for positives and p for negatives: an order statistic, not interpolated.
    Equal values are counted first: ties don't change the value at a place.
    """
    odd = F.when(F.col(target) == 1, 1 - F.col(score)).otherwise(F.col(score))
    own = [*keys, "__y"]
    points = ranked_points(rows.select(*keys, F.col(target).alias("__y"), odd.alias("__s")), own, "__s", "__y")
    totals = points.groupBy(*own).agg(F.max("cum_n").alias("n_rows"))
    k = F.least(F.ceil((F.col("n_rows") + 1) * F.lit(1 - alpha)), F.col("n_rows"))
    below = F.col("n_rows") - F.col("cum_n")  # values below this one
    cut = points.join(totals, own).where((below < k) & (k <= below + F.col("n"))).select(*own, F.col("score").alias("__s"))
    one = F.lit(1.0)
    return cut.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__y") == 1, F.col("__s"))), one).alias("q_pos"), F.coalesce(F.max(F.when(F.col("__y") == 0, F.col("__s"))), one).alias("q_neg")
    )


def conformal_set(score: Column, q_pos: Column, q_neg: Column) -> Column:
    """HIGH_RISK_SET, LOW_RISK_SET, or UNCERTAIN_SET where both classes or none are plausible."""
    high, low = 1 - score <= q_pos, score <= q_neg
    return F.when(high & ~low, "HIGH_RISK_SET").when(low & ~high, "LOW_RISK_SET").otherwise("UNCERTAIN_SET")


def conformal_coverage(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """(keys, coverage, coverage_pos, coverage_neg, uncertain_share) of rows with q_pos and q_neg."""
    y = F.col(target)
    covered = F.when(y == 1, 1 - F.col(score) <= F.col("q_pos")).otherwise(F.col(score) <= F.col("q_neg")).cast("double")
    named = conformal_set(F.col(score), F.col("q_pos"), F.col("q_neg"))
    return rows.groupBy(*keys).agg(
        F.avg(covered).alias("coverage"), F.avg(F.when(y == 1, covered)).alias("coverage_pos"), F.avg(F.when(y == 0, covered)).alias("coverage_neg"),
        F.avg((named == "UNCERTAIN_SET").cast("double")).alias("uncertain_share"),
    )


def tier_thresholds(rows: DataFrame, keys: list[str], critical: int = 25, urgent: int = 100, recall: float = 0.90, score: str = "score", target: str = "target") -> DataFrame:
    """(keys, critical_risk, urgent_risk, standard_risk): order statistics of the scores; standard never above urgent.

    Equal scores are counted first: ties don't change the score at a place.
    """
    points = ranked_points(rows, keys, score, target)
    at = lambda k: F.coalesce(F.max(F.when(F.col("cum_n") >= k, F.col("score"))), F.min("score"))
    top = points.groupBy(*keys).agg(at(critical).alias("critical_risk"), at(urgent).alias("urgent_risk"))
    totals = points.groupBy(*keys).agg(F.max("cum_p").alias("n_pos"))
    skip = F.greatest(F.floor(F.lit(1 - recall) * F.col("n_pos")), F.lit(0)) + 1
    below = F.col("n_pos") - F.col("cum_p")  # positives with lower scores
    low = points.where("p > 0").join(totals, keys)
    standard = low.where((below < skip) & (skip <= below + F.col("p"))).groupBy(*keys).agg(F.max("score").alias("s"))
    return top.join(standard, keys, "left").select(*keys, "critical_risk", "urgent_risk", F.least(F.coalesce("s", F.lit(0.5)), F.col("urgent_risk")).alias("standard_risk"))


def risk_tier(risk: Column, critical: Column, urgent: Column, standard: Column, conformal: Column, ood: Column, anomaly: Column, verified: Column, anomaly_cut: float = 99.0) -> Column:
    """Tier by precedence: out of distribution, risk bands, lifts of the lowest band, cap of the highest."""
    band = F.when(risk >= critical, "CRITICAL_REVIEW").when(risk >= urgent, "URGENT_REVIEW").when(risk >= standard, "STANDARD_REVIEW").otherwise("MONITOR")
    lifted = F.when((band == "MONITOR") & ((conformal == "UNCERTAIN_SET") | F.coalesce(anomaly >= anomaly_cut, F.lit(False))), "STANDARD_REVIEW").otherwise(band)
    capped = F.when((lifted == "CRITICAL_REVIEW") & F.coalesce(~verified, F.lit(False)) & (conformal != "HIGH_RISK_SET"), "URGENT_REVIEW").otherwise(lifted)
    return F.when(ood == "OUT_OF_DISTRIBUTION", "OOD_REVIEW").otherwise(capped)


def dampened(risk: Column, strong: Column, factor: float = 0.85, floor: float = 0.70) -> Column:
    """The risk times the factor, no less than the floor, where business evidence is strong."""
    return F.when(strong, risk * F.lit(max(factor, floor))).otherwise(risk)


def percentile_of(rows: DataFrame, reference: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The rows with percentile: the share of reference scores at or below theirs, times 100.

    Both sides are counted per distinct score and summed together, so no array of reference scores
    is sent around. reference: (keys, score).
    """
    from pyspark.sql import Window

    mine = rows.select(*keys, F.col(score).alias("__s")).distinct().withColumn("__r", F.lit(0).cast("bigint"))
    theirs = reference.groupBy(*keys, F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__r"))
    both = mine.unionByName(theirs).groupBy(*keys, "__s").agg(F.sum("__r").alias("__r")).withColumn("__b", F.floor(F.col("__s") * 1024))
    before = Window.partitionBy(*keys).orderBy("__b")
    buckets = both.groupBy(*keys, "__b").agg(F.sum("__r").alias("__t"))
    offset = buckets.select(*keys, "__b", (F.sum("__t").over(before) - F.col("__t")).alias("__o"), F.sum("__t").over(Window.partitionBy(*keys)).alias("__n"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__s")
    share = both.join(offset, [*keys, "__b"]).select(*keys, F.col("__s").alias(score), (divide(F.col("__o") + F.sum("__r").over(inside), F.col("__n")) * 100.0).alias("percentile"))
    return rows.join(share, [*keys, score])


def blends(rows: DataFrame, keys: list[str], model: str = "model", row: str = "row_index", score: str = "score") -> DataFrame:
    """(keys, row, prob_mean, logit_mean, rank_mean, rank_median, borda) over the models of a row."""
    ranked = ordinal_percentile(rows, [*keys, model], score, row)
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    return ranked.groupBy(*keys, row).agg(
        F.avg(score).alias("prob_mean"), F.avg(F.log(p / (1 - p))).alias("logit_mean"), F.avg("pct_rank").alias("rank_mean"), F.percentile("pct_rank", F.lit(0.5)).alias("rank_median"), F.sum(F.col("rn") - 1).alias("borda")
    )


def performance_weights(metrics: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """(keys, model, weight): AP above prevalence, normalised; equal weights where no model is above it."""
    from pyspark.sql import Window

    gain = F.greatest(F.coalesce("ap", F.lit(0.0)) - F.col("n_pos") / F.col("n_rows"), F.lit(0.0))
    total, n = F.sum("__g").over(Window.partitionBy(*keys)), F.count(F.lit(1)).over(Window.partitionBy(*keys))  # one row a model
    return metrics.withColumn("__g", gain).select(*keys, model, F.coalesce(divide(F.col("__g"), total), 1.0 / n).alias("weight"))


def weighted_blend(rows: DataFrame, weights: DataFrame, keys: list[str], model: str = "model", row: str = "row_index", score: str = "score") -> DataFrame:
    """(keys, row, score): the models' scores summed by weight."""
    return rows.join(weights, [*keys, model]).groupBy(*keys, row).agg(F.sum(F.col("weight") * F.col(score)).alias("score"))


def simplex_grid(spark, models: list[str], steps: int) -> DataFrame:
    """(grid, model, weight): all ways to share `steps` equal parts among the models; a small, fixed table."""
    ways = [[]]
    for _ in models[:-1]:
        ways = [[*w, i] for w in ways for i in range(steps - sum(w) + 1)]
    rows = [(g, m, part / steps) for g, w in enumerate(ways) for m, part in zip(models, [*w, steps - sum(w)])]
    return spark.createDataFrame(rows, "grid int, model string, weight double")


def agreement_profile(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, mean, sd, spread, status) of several models' scores: consensus within 0.15, partial within 0.35."""
    out = rows.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("sd_score"), (F.max(score) - F.min(score)).alias("spread"))
    return out.withColumn("status", F.when(F.col("spread") <= 0.15, "MODEL_CONSENSUS").when(F.col("spread") <= 0.35, "PARTIAL_AGREEMENT").otherwise("MODEL_DISAGREEMENT"))


def label_audit(percentiles: DataFrame, low: float = 50.0, high: float = 99.5, agreement: float = 0.80) -> DataFrame:
    """(row_index, target, mean/min/max_percentile, mean_score, n_evaluations, share_low, share_high, flag) of rows whose rank contradicts their label."""
    share = lambda test: F.avg(test.cast("double"))
    rows = percentiles.groupBy("row_index").agg(
        F.max("target").alias("target"), F.avg("percentile").alias("mean_percentile"), F.min("percentile").alias("min_percentile"), F.max("percentile").alias("max_percentile"),
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_evaluations"), share(F.col("percentile") <= low).alias("share_low"), share(F.col("percentile") >= high).alias("share_high"),
    )
    flag = F.when((F.col("target") == 1) & (F.col("share_low") >= agreement), "POSSIBLE_LABEL_NOISE").when((F.col("target") == 0) & (F.col("share_high") >= agreement), "HIGH_SCORING_NEGATIVE")
    return rows.withColumn("flag", flag).where("flag IS NOT NULL")


def unanimous_low(ranked: DataFrame, keys: list[str], below: float = 0.5) -> DataFrame:
    """(keys, row_index) of positives that every model ranks strictly below a percentile."""
    return ranked.where("target = 1").groupBy(*keys, "row_index").agg(F.bool_and(F.col("pct_rank") < below).alias("all_low")).where("all_low").select(*keys, "row_index")


#: Order and categories of the miss rules (fixed values).
MISS_RULES = ("MISSING_DATA", "OOD_PATTERN", "THRESHOLD_MISS", "MODEL_DISAGREEMENT", "LOOKALIKE_MULE", "LOW_SIGNAL_MULE")


def miss_category(rows: DataFrame, z: float = 4.0, share: float = 0.20, missing: float = 0.50, multiple: float = 2.0) -> DataFrame:
    """The rows with category (the first rule that holds) and fired (all that hold but the residual)."""
    c = F.col
    tests = (
        (c("missingness_z") >= z) | (c("missing_fraction") >= missing),
        (c("knn_distance") > c("knn_threshold")) | (c("range_violation_share") > share),
        c("champion_rank") <= multiple * c("budget_k"),
        c("n_peer_families_within_budget") >= 1,
        (c("n_mule_labels_in_neighbourhood") == 0) & (c("distance_to_nearest_legitimate_account") < c("distance_to_nearest_known_mule")),
    )
    held = [F.coalesce(t, F.lit(False)) for t in tests]
    category = F.lit(MISS_RULES[-1])
    for name, test in reversed(list(zip(MISS_RULES, held))):
        category = F.when(test, name).otherwise(category)
    fired = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in zip(MISS_RULES, held))))
    return rows.withColumns({"category": category, "fired": F.array_join(fired, ",")})
