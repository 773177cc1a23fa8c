"""Review-capacity curves and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import divide


def budget_grid(spark, n: int) -> DataFrame:
    """(budget): 1..300, then every 10 to 1000, every 100 to n, and n itself; none above n."""
    parts = [f"SELECT explode(sequence(1, {min(300, n)})) AS budget"]
    if n > 300:
        parts.append(f"SELECT explode(sequence(310, {max(310, min(1000, n))}, 10))")
    if n > 1000:
        parts.append(f"SELECT explode(sequence(1100, {max(1100, n)}, 100))")
    return spark.sql(" UNION ".join([*parts, f"SELECT {n}"])).where(f"budget <= {n}").select(F.col("budget").cast("bigint").alias("budget")).distinct()


def capacity_curve(ranked: DataFrame, points: DataFrame, keys: list[str], grid: DataFrame, target: str = "target") -> DataFrame:
    """Per key and budget: hits, misses, recall, precision, false positives per 1000 on both bases, the threshold and its alerts.

    ranked: rows with rn; only the rows whose place is a budget are kept, each with the hits above it
    taken from the points' running totals, so the curve costs two joins and no cross product.
    """
    totals = points.groupBy(*keys).agg(F.max("cum_n").alias("n_rows"), F.max("cum_p").alias("n_pos"))
    cuts = ranked.join(F.broadcast(grid), F.col("rn") == F.col("budget")).select(*keys, "budget", F.col("score").alias("threshold_score"))  # the grid has a few thousand rows at most
    at = cuts.join(points.select(*keys, F.col("score").alias("threshold_score"), "n", "p", "cum_n", "cum_p"), [*keys, "threshold_score"])
    # hits inside the tied group up to the budget need its rows; elsewhere the totals above it do
    inside = ranked.withColumnRenamed("score", "threshold_score").join(at.select(*keys, "budget", "threshold_score"), [*keys, "threshold_score"]).where(F.col("rn") <= F.col("budget"))
    tied = inside.groupBy(*keys, "budget").agg(F.sum(F.col(target).cast("bigint")).alias("__in"))
    tp, b, pos, n = F.col("true_positives"), F.col("budget"), F.col("n_pos"), F.col("n_rows")
    joined = at.join(tied, [*keys, "budget"]).join(totals, keys).withColumn("true_positives", F.col("cum_p") - F.col("p") + F.col("__in"))
    return joined.select(
        *keys, "budget", "true_positives", (b - tp).alias("false_positives"), (pos - tp).alias("missed"), divide(tp, pos).alias("recall"), (tp / b).alias("precision"),
        F.coalesce(divide((b - tp) * 1000.0, n - pos), F.lit(0.0)).alias("fp_per_1000_legitimate"), ((b - tp) * 1000.0 / n).alias("fp_per_1000_screened"), "threshold_score", F.col("cum_n").alias("n_alerts_at_threshold"),
    )


def leading_run(ranked: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """(keys, leading_run): how many rows from the top are positives before the first that is not."""
    return ranked.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(target) == 0, F.col("rn"))) - 1, F.max("n_rows")).alias("leading_run"))


def plan_for_budget(curve: DataFrame, keys: list[str], asked: int) -> DataFrame:
    """The curve's row of the largest measured budget of at most `asked` (the smallest row if none)."""
    rest = [c for c in curve.columns if c not in keys]
    below = F.max_by(F.struct(*rest), F.when(F.col("budget") <= asked, F.col("budget")))
    first = F.min_by(F.struct(*rest), "budget")
    return curve.groupBy(*keys).agg(F.coalesce(below, first).alias("r")).select(*keys, F.lit(asked).cast("bigint").alias("asked"), "r.*")


def plan_for_fp(curve: DataFrame, keys: list[str], most: float, basis: str = "legitimate") -> DataFrame:
    """The curve's row of the largest budget whose false positives per 1000 stay within `most`; no row if none does."""
    rest = [c for c in curve.columns if c not in keys]
    inside = curve.where(F.col(f"fp_per_1000_{basis}") <= most + 1e-12)
    return inside.groupBy(*keys).agg(F.max_by(F.struct(*rest), "budget").alias("r")).select(*keys, F.lit(most).alias("max_fp_per_1000"), "r.*")
