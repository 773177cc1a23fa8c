"""Small row-wise operators around scores, and whole documents composed from the metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as rk
from .splits import shuffle_hash

#: Age edges of the fairness groups (fixed values).
AGE_EDGES = (25, 35, 45, 55, 65)


def binarised(value: Column) -> Column:
    """1 for positive values, else 0; null stays null."""
    return (value > 0).cast("int")


def edge_group(value: Column, edges: tuple[float, ...] = AGE_EDGES) -> Column:
    """'<25', '25-34', ..., '65+', or NOT_RECORDED for null."""
    out = F.lit(f"{edges[-1]}+")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when(value < high, f"{low}-{high - 1}").otherwise(out)
    return F.when(value.isNull(), "NOT_RECORDED").when(value < edges[0], f"<{edges[0]}").otherwise(out)


def row_label(row: Column) -> Column:
    """RV-<row>."""
    return F.concat(F.lit("RV-"), row.cast("string"))


def label_row(label: Column) -> Column:
    """The row of an RV- label, null for other texts."""
    return F.nullif(F.regexp_extract(label, "^RV-([0-9]+)$", 1), F.lit("")).cast("bigint")


def reason_text(reason: Column) -> Column:
    """'feature=value (raises)' of one reason."""
    return F.format_string("%s=%s (%s)", reason["feature"], F.format_number(reason["value"], 2), F.when(reason["raises"], "raises").otherwise("lowers"))


def band_of(threshold: Column, critical: Column, urgent: Column, standard: Column) -> Column:
    """The policy band a threshold lies in."""
    return F.when(threshold >= critical, "at or above CRITICAL_REVIEW").when(threshold >= urgent, "between URGENT_REVIEW and CRITICAL_REVIEW").when(threshold >= standard, "between STANDARD_REVIEW and URGENT_REVIEW").otherwise("below STANDARD_REVIEW")


def escalation_confidence(conformal: Column, agreement: Column, strong_business: Column) -> Column:
    """HIGH, MEDIUM or LOW: one step down for each of abstention (to MEDIUM), disagreement and strong business evidence."""
    steps = (conformal == "UNCERTAIN_SET").cast("int") + (agreement < 0.5).cast("int") + strong_business.cast("int")
    return F.when(steps == 0, "HIGH").when(steps == 1, "MEDIUM").otherwise("LOW")


def percentile_band(rows: DataFrame, keys: list[str], score: str, cuts: tuple[tuple[float, str], ...], otherwise: str, settle) -> DataFrame:
    """The rows with band by the share of scores at or below theirs."""
    points = rk.ranked_points(rows.withColumn("__t", F.lit(0)), keys, score, "__t")
    totals = points.groupBy(*keys).agg(F.max("cum_n").alias("__all"))
    share = (F.col("__all") - F.col("cum_n") + F.col("n")) / F.col("__all")
    placed = points.join(totals, keys) if keys else points.crossJoin(totals)
    banded = placed.select(*keys, F.col("score").alias(score), reduce(lambda rest, c: F.when(share >= c[0], c[1]).otherwise(rest), reversed(cuts), F.lit(otherwise)).alias("band"))
    return rk.join_scores(rows, banded, keys, score, settle)


def thinned_grid(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, place, score): at most `size` scores at even steps of the ranking, the lowest and highest among them.

    Each score works out which places fall on its records, so the grid needs no join with the scores.
    """
    totals = points.groupBy(*keys).agg(F.max("cum_n").alias("__total"))
    joined = points.join(totals, keys) if keys else points.crossJoin(F.broadcast(totals))  # one row
    total = F.col("__total")
    steps, width = F.least(total, F.lit(size)) - 1, total - 1
    up = lambda a: F.when(width > 0, F.floor((a * steps + width - 1) / F.when(width > 0, width))).otherwise(0)  # noqa: E731 - the quotient rounded up
    rank = total - F.col("cum_n")
    low, high = up(rank), F.least(F.when(width > 0, up(rank + F.col("n")) - 1).otherwise(0), steps)
    placed = joined.where(F.col("n") > 0).select(*keys, "score", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).where("low <= high")
    return placed.select(*keys, F.explode(F.sequence("low", "high")).alias("place"), "score")


def safe_auc(rows: DataFrame, keys: list[str], score: str, target: str = "target") -> DataFrame:
    """(keys, auc): null where the label or the score is constant."""
    points = rk.ranked_points(rows, keys, score, target)
    flat = points.groupBy(*keys).agg((F.count(F.lit(1)) < 2).alias("flat"))
    auc = rk.average_precision_roc(points, keys)
    joined = auc.join(flat, keys) if keys else auc.crossJoin(flat)
    return joined.select(*keys, F.when(~F.col("flat"), F.col("roc_auc")).alias("auc"))


def battery(rows: DataFrame, keys: list[str], threshold: float, budgets: tuple[int, ...] = rk.BUDGETS) -> DataFrame:
    """(keys, metric, value): ranking, budget, threshold and probability metrics as one long document."""
    points, ranked = rk.ranked_points(rows, keys), rk.ranked_rows(rows, keys)
    parts = [
        rk.average_precision_roc(points, keys).unpivot(keys, ["ap", "roc_auc"], "metric", "value"),
        rk.at_budgets(ranked, keys, budgets).select(*keys, F.concat(F.lit("recall_at_"), "budget").alias("metric"), F.col("recall").alias("value")),
        rk.confusion_metrics(rk.confusion(rows, keys, threshold)).unpivot(keys, ["precision", "recall", "f1", "mcc"], "metric", "value"),
        rk.probability_quality(rows, keys).unpivot(keys, ["brier", "log_loss"], "metric", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def random_pairs(rows: DataFrame, key: str, values: list[str], n_rounds: int, seed: int, pieces: int = 256) -> DataFrame:
    """(round, key, values of both): each row beside the next of its hash-shuffled order, n_rounds times: random pairs without a product of rows.

    An order is cut into pieces by the hash; the last row of a piece has no partner.
    """
    each = rows.select(key, *values, F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1))).alias("round"))
    h = shuffle_hash(F.col(key), F.col("round") + seed)
    order = Window.partitionBy("round", "__p").orderBy("__h", key)
    nxt = [F.lead(c).over(order).alias(f"{c}_b") for c in (key, *values)]
    return each.withColumn("__h", h).withColumn("__p", F.pmod("__h", F.lit(pieces))).select("round", key, *values, *nxt).where(F.col(f"{key}_b").isNotNull())


def probe_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that come first in hash order, in order of key."""
    return df.orderBy(shuffle_hash(F.col(key), seed), key).limit(n).orderBy(key)


def weights_by_share(head: DataFrame, gains: DataFrame, tail_share: float) -> DataFrame:
    """(feature, weight): head features by their share of 1 - tail_share, the others by gain of tail_share, normalised.

    head: (feature, share), gains: (feature, gain); one row a feature.
    """
    every = Window.partitionBy(F.lit(1))
    a = head.select("feature", (F.col("share") / F.sum("share").over(every) * (1 - tail_share)).alias("w"))
    rest = gains.join(head, "feature", "left_anti")
    b = rest.select("feature", (rk.divide(F.col("gain"), F.sum("gain").over(every)) * tail_share).alias("w"))
    return a.union(b).select("feature", (F.col("w") / F.sum("w").over(every)).alias("weight"))
