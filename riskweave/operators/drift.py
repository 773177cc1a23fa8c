"""Drift between a reference and a current load, and inputs unlike the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import linear_quantiles, value_counts

#: Bands of the population stability index and limits of the status (fixed values).
PSI_MODERATE, PSI_ALERT, BINS, FLOOR, LEAST_ROWS = 0.10, 0.25, 10, 1e-6, 20
#: Out-of-distribution limits (fixed values).
Z_LIMIT, VIOLATION_SHARE, RANGE_MARGIN = 4.0, 0.20, 0.2


def _edges(reference: DataFrame, inner: bool) -> DataFrame:
    cuts = {f"e{i}": i / BINS for i in (range(1, BINS) if inner else range(BINS + 1))}
    counts = value_counts(reference, ["feature"])
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("n_ref"), F.count(F.lit(1)).alias("k_ref"))
    return linear_quantiles(counts, ["feature"], cuts).select("feature", F.array_distinct(F.array(*cuts)).alias("edges")).join(sizes, "feature")


def _psi(cells: DataFrame) -> DataFrame:
    """Cells (feature, n_bins, bin, a, b) to (feature, psi): bins without rows count as FLOOR."""
    whole = cells.groupBy("feature").agg(F.max("n_bins").alias("n_bins"), F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    grid = whole.select("feature", "ta", "tb", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin")).join(cells.select("feature", "bin", "a", "b"), ["feature", "bin"], "left")
    p, q = (F.greatest(F.coalesce(F.col(c) / F.greatest(F.col(t), F.lit(1)), F.lit(0.0)), F.lit(FLOOR)) for c, t in (("a", "ta"), ("b", "tb")))
    return grid.groupBy("feature").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def _cells(long: DataFrame, side: str, edges: DataFrame, bin_: Column, n_bins: Column) -> DataFrame:
    rows = long.where("value IS NOT NULL").join(edges, "feature").select("feature", n_bins.cast("int").alias("n_bins"), bin_.cast("int").alias("bin"), F.col(side).alias("s"))
    return rows.where("bin IS NOT NULL").groupBy("feature", "n_bins", "bin").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))


def psi_open(long: DataFrame, side: str = "is_reference") -> DataFrame:
    """(feature, psi) with open outer bins at the reference's inner deciles; features with under 20 values or one value are left out."""
    edges = _edges(long.where(side), inner=True).where((F.col("n_ref") >= LEAST_ROWS) & (F.col("k_ref") > 1))
    at = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return _psi(_cells(long, side, edges, at, F.size("edges") + 1))


def psi_closed(long: DataFrame, side: str = "is_reference") -> DataFrame:
    """(feature, psi) with the reference's outer edges kept: values outside them are dropped; 0 for under 20 values on a side or fewer than 3 edges."""
    edges = _edges(long.where(side), inner=False)
    top = F.element_at("edges", -1)
    below = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    inside = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= top)
    at = F.when(inside, F.least(below, F.size("edges") - 1) - 1)
    sizes = long.where("value IS NOT NULL").groupBy("feature").agg(F.count_if(F.col(side)).alias("na"), F.count_if(~F.col(side)).alias("nb"))
    fit = edges.join(sizes, "feature").select("feature", ((F.col("na") >= LEAST_ROWS) & (F.col("nb") >= LEAST_ROWS) & (F.size("edges") >= 3)).alias("fit"))
    usable = edges.join(fit.where("fit"), "feature").drop("fit")
    scored = _psi(_cells(long, side, usable, at, F.size("edges") - 1))
    return fit.join(scored, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def drift_report(long: DataFrame, side: str = "is_reference") -> DataFrame:
    """(feature, psi, missing_shift, band) of the features with a PSI."""
    shift = long.groupBy("feature").agg((F.avg(F.when(~F.col(side), F.col("value").isNull().cast("double"))) - F.avg(F.when(F.col(side), F.col("value").isNull().cast("double")))).alias("missing_shift"))
    band = F.when(F.col("psi") > PSI_ALERT, "ALERT").when(F.col("psi") > PSI_MODERATE, "MODERATE").otherwise("STABLE")
    return psi_open(long, side).join(shift, "feature").select("feature", "psi", "missing_shift", band.alias("band"))


def drift_status(report: DataFrame) -> DataFrame:
    """One row: ALERT if any feature is, MODERATE if more than two are, else STABLE."""
    n = lambda b: F.count_if(F.col("band") == b)
    return report.agg(n("ALERT").alias("n_alert"), n("MODERATE").alias("n_moderate")).select("n_alert", "n_moderate", F.when(F.col("n_alert") > 0, "ALERT").when(F.col("n_moderate") > 2, "MODERATE").otherwise("STABLE").alias("status"))


def out_of_distribution(long: DataFrame, key: str, side: str = "is_reference") -> DataFrame:
    """(key, missing_z, violation_share, status) of every row, judged by the reference rows' missing shares and widened ranges."""
    ref = long.where(side)
    ranges = ref.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.when(F.col("hi") - F.col("lo") <= 0, 1.0).otherwise(F.col("hi") - F.col("lo"))
    wide = ranges.select("feature", (F.col("lo") - RANGE_MARGIN * span).alias("lo"), (F.col("hi") + RANGE_MARGIN * span).alias("hi"))
    out = F.coalesce(((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))), F.lit(False))
    rows = long.join(wide, "feature").groupBy(key, side).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.avg(out.cast("double")).alias("violation_share"))
    base = rows.where(side).agg(F.avg("missing").alias("mu"), (F.stddev_pop("missing") + 1e-12).alias("sd"))
    judged = rows.crossJoin(F.broadcast(base)).withColumn("missing_z", (F.col("missing") - F.col("mu")) / F.col("sd"))  # one row
    bad = (F.col("missing_z") > Z_LIMIT) | (F.col("violation_share") > VIOLATION_SHARE)
    return judged.select(key, "missing_z", "violation_share", F.when(bad, "OUT_OF_DISTRIBUTION").otherwise("IN_DISTRIBUTION").alias("status"))


def range_coverage(long: DataFrame, side: str = "is_reference") -> DataFrame:
    """(feature, is_inside): whether the current median lies within the reference's 1st..99th percentile."""
    ref = linear_quantiles(value_counts(long.where(side), ["feature"]), ["feature"], {"p1": 0.01, "p99": 0.99})
    cur = linear_quantiles(value_counts(long.where(~F.col(side)), ["feature"]), ["feature"], {"m": 0.5})
    return ref.join(cur, "feature").select("feature", F.col("m").between(F.col("p1"), F.col("p99")).alias("is_inside"))


def compatibility(schema: Column, shield_auc: Column, missing: Column, ranges: Column) -> Column:
    """Weighted 40/30/15/15 score of four shares, 0..100."""
    separation = F.least(F.greatest((1 - shield_auc) / 0.5, F.lit(0.0)), F.lit(1.0))
    return 40.0 * schema + 30.0 * separation + 15.0 * missing + 15.0 * ranges


def compatibility_band(score: Column) -> Column:
    """EXCELLENT from 85, GOOD from 70, FAIR from 50, else POOR."""
    return F.when(score >= 85, "EXCELLENT").when(score >= 70, "GOOD").when(score >= 50, "FAIR").otherwise("POOR")
