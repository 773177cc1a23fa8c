"""Tables that only grow, and what is asked of them: latest rows, queues, snapshots, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import divide

#: Largest difference of two snapshots that counts as none; most rows of a queue (fixed values).
TOLERANCE, QUEUE_LIMIT = 1e-12, 500


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key by the given order (descending columns): last write wins."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


def queue(cases: DataFrame, risk: str, key: str, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The open cases with the highest risk, ties by key: a top-k that no task sorts whole."""
    return cases.orderBy(F.col(risk).desc(), key).limit(min(limit, QUEUE_LIMIT))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, score: str, tier: str, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: rows on one side only, largest score difference, rows beyond the tolerance, changed tiers, and PASS or FAIL."""
    a = before.select(key, F.col(score).alias("__a"), F.col(tier).alias("__ta"), F.lit(1).alias("__in_a"))
    b = after.select(key, F.col(score).alias("__b"), F.col(tier).alias("__tb"), F.lit(1).alias("__in_b"))
    gap = F.abs(F.col("__a") - F.col("__b"))
    out = a.join(b, key, "full").agg(
        F.count_if(F.col("__in_b").isNull()).alias("n_lost"), F.count_if(F.col("__in_a").isNull()).alias("n_new"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"),
        F.count_if(gap > tolerance).alias("n_moved"), F.count_if(~F.col("__ta").eqNullSafe(F.col("__tb")) & F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()).alias("n_tier_changed"),
    )
    fine = (F.col("n_lost") == 0) & (F.col("n_new") == 0) & (F.col("n_moved") == 0) & (F.col("n_tier_changed") == 0)
    return out.withColumn("verdict", F.when(fine, "PASS").otherwise("FAIL"))


def fingerprint(features: list[str]) -> Column:
    """sha256 of the sorted features as JSON; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(features))), 256)


def names_forbidden(payload: Column, names: list[str]) -> Column:
    """Whether a text names one of the columns as a whole token."""
    return payload.rlike("(?:^|[^A-Za-z0-9_])(?:" + "|".join(names) + ")(?:$|[^A-Za-z0-9_])")


def redact(payload: Column, names: list[str]) -> Column:
    """A JSON object of texts without the named keys."""
    kept = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.isin(*names))
    return F.to_json(kept)


def impact(curve: DataFrame, capacity: int, minutes: float, hourly: float, exposure: float) -> DataFrame:
    """Hours, cost and exposure at the largest measured budget of at most `capacity`; no row below 1."""
    if capacity < 1:
        return curve.limit(0).select(F.lit(0).cast("bigint").alias("budget"), *(F.lit(0.0).alias(c) for c in ("hours", "cost", "surfaced")), F.lit(0).cast("bigint").alias("missed"))
    row = curve.where(F.col("budget") <= capacity).agg(F.max_by(F.struct("budget", "true_positives", "missed"), "budget").alias("r")).select("r.*").where("budget IS NOT NULL")
    hours = F.col("budget") * F.lit(minutes) / 60
    return row.select("budget", hours.alias("hours"), (hours * hourly).alias("cost"), (F.col("true_positives") * F.lit(exposure)).alias("surfaced"), "missed")


def evidence_balance(rows: DataFrame, key: str) -> DataFrame:
    """(key, for_weight, against_weight, balance, contested, verdict) of rows with reasons and doubts.

    rows: key, risk, tier, status, reasons array<struct<weight, raises>>, doubts array<struct<weight>>.
    """
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pro = add(F.transform(F.filter("reasons", lambda r: r["raises"]), lambda r: r["weight"]))
    con = add(F.transform(F.filter("reasons", lambda r: ~r["raises"]), lambda r: r["weight"])) + add(F.transform("doubts", lambda d: d["weight"]))
    balance = F.coalesce(divide(pro, pro + con), F.lit(0.0))
    contested = (F.col("status") == "MODEL_DISAGREEMENT") | (F.size("doubts") > 0)
    calm = F.col("tier").isin("MONITOR", "NO_ACTION") | (F.col("risk") < 0.2)
    verdict = F.when(calm & (F.col("risk") >= 0.05), "MONITOR").when(calm, "NO_ACTION").when(pro == 0, "INSUFFICIENT_EVIDENCE").when((balance >= 0.65) & ~contested, "ENHANCED_REVIEW").when(balance >= 0.5, "REVIEW").otherwise("INSUFFICIENT_EVIDENCE")
    return rows.select(key, pro.alias("for_weight"), con.alias("against_weight"), balance.alias("balance"), contested.alias("contested"), verdict.alias("verdict"))


def doubts(agreement: Column, conformal: Column, ood: Column, anomaly: Column, verified: Column) -> Column:
    """Array of (doubt, weight) that a score itself gives rise to."""
    node = lambda name, weight: F.struct(F.lit(name).alias("doubt"), weight.cast("double").alias("weight"))
    return F.array_compact(F.array(
        F.when(agreement < 0.85, node("model_agreement", 1 - agreement)), F.when(conformal == "UNCERTAIN_SET", node("conformal", F.lit(0.5))), F.when(ood != "IN_DISTRIBUTION", node("ood", F.lit(0.6))),
        F.when(anomaly < 80, node("anomaly", (80 - anomaly) / 100.0)), F.when(~verified, node("verifier", F.lit(0.7))),
    ))


def top_contributions(contributions: Column, k: int) -> Column:
    """The k entries of array<struct<feature, value>> with the largest absolute value, ties by feature."""
    keyed = F.transform(contributions, lambda c: F.struct((-F.abs(c["value"])).alias("k"), c["feature"].alias("feature"), c["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value")))
