"""Ranking metrics with exact ties.

One frame serves them all: records counted per distinct score, with running totals
from the highest score down. Running totals are made in two steps, so that no task
holds a whole ranking: totals of score buckets first (bounded in number), then
within each bucket, and the sum of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast

#: Score buckets of a ranking, and distinct scores of all rankings that may be broadcast.
BUCKETS, MOST_SCORES = 1024, 500_000
#: Review budgets, false-positive targets and catch shares (fixed values).
BUDGETS = (10, 18, 25, 50, 100)
FPR_TARGETS = (0.005, 0.01)
CATCH_SHARES = (0.50, 0.75, 0.90)


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of the rows that have both, null where one of them is constant (the built-in raises there)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _bucket(score: Column) -> Column:
    return F.least(F.greatest(F.floor(score * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def ranked_points(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """(keys, score, n, p, cum_n, cum_p): per distinct score the records and positives, and both summed down to it.

    Scores of 0..1 spread over the buckets; others fall into the outer ones and stay exact. Rows
    with a null score are left out; an empty input gives an empty result. weight: a column of whole
    numbers, how often a row counts.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    points = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w.cast("bigint")).alias("n"), F.sum((w * F.col(target)).cast("bigint")).alias("p")).where("n > 0")
    points = points.withColumn("bucket", _bucket(F.col("score")))
    before = Window.partitionBy(*keys).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = points.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp")).select(
        *keys, "bucket", F.coalesce(F.sum("bn").over(before), zero).alias("n0"), F.coalesce(F.sum("bp").over(before), zero).alias("p0")
    )
    down = Window.partitionBy(*keys, "bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return points.join(offsets, [*keys, "bucket"]).select(
        *keys, "score", "n", "p", (F.col("n0") + F.sum("n").over(down)).alias("cum_n"), (F.col("p0") + F.sum("p").over(down)).alias("cum_p")
    )


def ranked_rows(rows: DataFrame, keys: list[str], score: str = "score", tie: str = "row_index", ascending: bool = False) -> DataFrame:
    """The rows with rn, their place from the highest (or lowest) score, ties in order of `tie`, and n_rows of their key."""
    sign = 1 if ascending else -1
    marked = rows.where(F.col(score).isNotNull()).withColumn("__b", _bucket(F.col(score)) * sign)
    before = Window.partitionBy(*keys).orderBy("__b")
    sizes = marked.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*keys, "__b", (F.sum("__n").over(before) - F.col("__n")).alias("__n0"), F.sum("__n").over(Window.partitionBy(*keys)).alias("n_rows"))
    down = Window.partitionBy(*keys, "__b").orderBy(F.col(score) * sign, tie)
    return marked.join(offsets, [*keys, "__b"]).withColumn("rn", F.col("__n0") + F.row_number().over(down)).drop("__b", "__n0")


def average_precision_roc(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, n_pos, ap, roc_auc); both null where a class is absent.

    AP adds precision times the gain in recall over the distinct scores; ROC takes trapezoids.
    """
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    sums = points.groupBy(*keys).agg(
        F.max("cum_n").alias("n_rows"), F.max("cum_p").alias("n_pos"), F.sum(p * F.col("cum_p") / F.col("cum_n")).alias("__ap"), F.sum(q * (F.col("cum_p") - p / 2)).alias("__roc")
    )
    pos, neg = F.col("n_pos"), F.col("n_rows") - F.col("n_pos")
    defined = (pos > 0) & (neg > 0)
    return sums.select(
        *keys, "n_rows", "n_pos", F.when(defined, divide(F.col("__ap"), pos)).alias("ap"), F.when(defined, divide(F.col("__roc"), pos * neg)).alias("roc_auc")
    )


def at_budgets(ranked: DataFrame, keys: list[str], budgets: tuple[int, ...] = BUDGETS, target: str = "target") -> DataFrame:
    """(keys, budget, k, tp, n_rows, n_pos, recall, precision): the top `budget` rows, at most all of them.

    A single aggregate holds every budget; recall is null without positives.
    """
    tp = [F.sum(F.when(F.col("rn") <= b, F.col(target).cast("bigint")).otherwise(0)).alias(f"__tp{b}") for b in budgets]
    one = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(target).cast("bigint")).alias("n_pos"), *tp)
    cells = F.explode(F.array(*(F.struct(F.lit(b).cast("bigint").alias("budget"), F.col(f"__tp{b}").alias("tp")) for b in budgets)))
    long = one.select(*keys, "n_rows", "n_pos", cells.alias("b")).select(*keys, "b.budget", F.least(F.col("b.budget"), F.col("n_rows")).alias("k"), "b.tp", "n_rows", "n_pos")
    return long.withColumn("recall", divide(F.col("tp"), F.col("n_pos"))).withColumn("precision", divide(F.col("tp"), F.col("k")))


def budget_economics(budgeted: DataFrame) -> DataFrame:
    """Adds the best recall and precision a budget can reach, reviews per hit and false positives per 1000 legitimate rows."""
    k, tp, pos, n = (F.col(c) for c in ("k", "tp", "n_pos", "n_rows"))
    return budgeted.withColumns({
        "recall_ceiling": divide(F.least(k, pos), pos), "reviews_per_hit": divide(k, tp), "fp_per_1000": divide((k - tp) * 1000.0, n - pos),
    })


def alerts_to_catch(points: DataFrame, keys: list[str], ranked: DataFrame, shares: tuple[float, ...] = CATCH_SHARES, target: str = "target") -> DataFrame:
    """(keys, share, needed, alerts): rows to review, from the top, until ceil(share * positives) are caught."""
    hits = ranked.where(F.col(target) == 1).select(*keys, "rn")
    totals = points.groupBy(*keys).agg(F.max("cum_p").alias("n_pos"))
    order = Window.partitionBy(*keys).orderBy("rn")  # positives are rare: their rows only
    placed = hits.withColumn("hit", F.row_number().over(order)).join(totals, keys)
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.ceil(F.col("n_pos") * F.lit(s) - 1e-9).alias("needed")) for s in shares)))
    return placed.select(*keys, "rn", "hit", cells.alias("c")).where("hit = c.needed").select(*keys, "c.share", "c.needed", F.col("rn").alias("alerts"))


def recall_at_fpr(rows: DataFrame, keys: list[str], targets: tuple[float, ...] = FPR_TARGETS, score: str = "score", target: str = "target") -> DataFrame:
    """(keys, fpr_target, threshold, recall, fpr, fp_per_1000): the threshold is the linear quantile of the negatives' scores."""
    s, y = F.col(score), F.col(target)
    cuts = rows.groupBy(*keys).agg(F.percentile(F.when(y == 0, s), F.array(*(F.lit(1 - t) for t in targets))).alias("cuts"), F.sum(F.col(target).cast("bigint")).alias("n_pos"), F.count(F.lit(1)).alias("n_rows"))
    flat = cuts.select(*keys, "n_pos", "n_rows", F.explode(F.arrays_zip(F.array(*(F.lit(t) for t in targets)).alias("fpr_target"), F.col("cuts").alias("threshold"))).alias("c")).select(*keys, "n_pos", "n_rows", "c.*")
    hit = rows.select(*keys, s.alias("__s"), y.alias("__y")).join(flat.select(*keys, "fpr_target", "threshold"), keys).where("__s >= threshold")
    counted = hit.groupBy(*keys, "fpr_target").agg(F.sum(F.col("__y").cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("k"))
    zero = F.lit(0).cast("bigint")
    out = flat.join(counted, [*keys, "fpr_target"], "left").withColumns({"tp": F.coalesce("tp", zero), "k": F.coalesce("k", zero)})
    fp, neg = F.col("k") - F.col("tp"), F.col("n_rows") - F.col("n_pos")
    return out.select(*keys, "fpr_target", "threshold", divide(F.col("tp"), F.col("n_pos")).alias("recall"), divide(fp, neg).alias("fpr"), divide(fp * 1000.0, neg).alias("fp_per_1000"))


def confusion(rows: DataFrame, keys: list[str], threshold: float | Column, score: str = "score", target: str = "target") -> DataFrame:
    """(keys, tp, fp, fn, tn) at a threshold; scores at it count as flagged."""
    flagged, y = F.col(score) >= threshold, F.col(target)
    cell = lambda a, b: F.count_if((flagged == F.lit(a)) & (y == b))
    return rows.groupBy(*keys).agg(cell(True, 1).alias("tp"), cell(True, 0).alias("fp"), cell(False, 1).alias("fn"), cell(False, 0).alias("tn"))


def confusion_metrics(cells: DataFrame) -> DataFrame:
    """Adds the metrics of four cells; each is null where its denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = divide(tp, tp + fp), divide(tp, tp + fn), divide(tn, tn + fp)
    f_beta = lambda b: divide((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    return cells.withColumns({
        "accuracy": divide(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + specificity) / 2, "precision": precision, "recall": recall, "specificity": specificity,
        "f1": f_beta(1), "f2": f_beta(2), "mcc": divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "npv": divide(tn, tn + fn),
        "fpr": divide(fp, fp + tn), "fnr": divide(fn, fn + tp), "fp_per_1000": divide(fp * 1000.0, fp + tn), "reviews_per_hit": divide(tp + fp, tp),
    })


def _mean(value: Column, weight: str | None) -> Column:
    """The mean of the rows that have a value; weight: a column of how often a row counts."""
    return F.avg(value) if weight is None else divide(F.sum(value * F.col(weight)), F.sum(F.when(value.isNotNull(), F.col(weight))))


def binned_calibration(rows: DataFrame, keys: list[str], edges: list[float] | Column, right_closed: bool = False, score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """(keys, bin, n, mean_score, rate) of probabilities in bins between edges; the outer bins take in their ends.

    edges: literal edges, or an array column. Left-closed bins by default. weight: how often a row counts.
    """
    s = F.col(score)
    inner = F.slice(edges, 2, F.size(edges) - 2) if isinstance(edges, Column) else F.array(*(F.lit(e) for e in edges[1:-1]))
    above = (lambda e: e < s) if right_closed else (lambda e: e <= s)
    at = F.size(F.filter(inner, above)).alias("bin")
    own = [] if weight is None else [weight]
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.select(*keys, *own, at, s.alias("__s"), F.col(target).cast("double").alias("__y")).groupBy(*keys, "bin").agg(n.alias("n"), _mean(F.col("__s"), weight).alias("mean_score"), _mean(F.col("__y"), weight).alias("rate"))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ece, mce) from bins: the weighted mean and the largest gap of score and rate."""
    gap = F.abs(F.col("mean_score") - F.col("rate"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def probability_quality(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """(keys, brier, log_loss, base_brier, brier_skill): probabilities clipped to 1e-15 from the ends for the log. weight: how often a row counts."""
    y, s = F.col(target).cast("double"), F.col(score)
    p = F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15))
    out = rows.groupBy(*keys).agg(_mean((s - y) ** 2, weight).alias("brier"), (-_mean(y * F.log(p) + (1 - y) * F.log(1 - p), weight)).alias("log_loss"), _mean(y, weight).alias("__base"))
    base = F.col("__base") * (1 - F.col("__base"))
    return out.select(*keys, "brier", "log_loss", base.alias("base_brier"), (1 - divide(F.col("brier"), base)).alias("brier_skill"))


def threshold_families(points: DataFrame, keys: list[str], precision: float = 0.50, recall: float = 0.90) -> DataFrame:
    """(keys, max_f1_threshold, max_f2_threshold, precision_threshold, recall_threshold).

    The highest threshold of the best F1 and F2; the lowest with at least the precision; the
    highest with at least the recall.
    """
    totals = points.groupBy(*keys).agg(F.max("cum_p").alias("__total"))
    p, n, total = F.col("cum_p").cast("double"), F.col("cum_n"), F.col("__total")
    f = lambda b: divide((1 + b * b) * p, b * b * total + n)
    best = lambda c: F.max(F.struct(F.round(c, 12), F.col("score")))["score"]
    return points.join(totals, keys).groupBy(*keys).agg(
        best(f(1)).alias("max_f1_threshold"), best(f(2)).alias("max_f2_threshold"),
        F.min(F.when(p / n >= precision, F.col("score"))).alias("precision_threshold"), F.max(F.when(divide(p, total) >= recall, F.col("score"))).alias("recall_threshold"),
    )


def ordinal_percentile(rows: DataFrame, keys: list[str], score: str = "score", tie: str = "row_index") -> DataFrame:
    """The rows with pct_rank, (place - 1) / (n - 1) from the lowest score, ties in order of `tie` (0 if alone)."""
    ranked = ranked_rows(rows, keys, score, tie, ascending=True)
    return ranked.withColumn("pct_rank", F.coalesce(divide(F.col("rn") - 1.0, F.col("n_rows") - 1), F.lit(0.0)))


def join_scores(rows: DataFrame, shares: DataFrame, keys: list[str], score: str, settle) -> DataFrame:
    """The rows with what shares, (keys, score, ...), has for their score.

    shares has one row a distinct score: few are sent around, else both sides are shuffled. The rows
    are never sent, whatever size Spark takes them for (it counts rows that an explode makes as one).
    """
    return rows.hint("merge").join(checked_broadcast(settle(shares), MOST_SCORES), [*keys, score])


def average_rank_percentile(rows: DataFrame, keys: list[str], settle, score: str = "score", target: str = "target") -> DataFrame:
    """The rows with percentile, 100 * average rank / n from the lowest score; equal scores share it."""
    points = ranked_points(rows, keys, score, target)
    totals = points.groupBy(*keys).agg(F.max("cum_n").alias("__n"))
    rank = F.col("__n") - F.col("cum_n") + (F.col("n") + 1) / 2.0
    shares = points.join(totals, keys).select(*keys, F.col("score").alias(score), (rank / F.col("__n") * 100.0).alias("percentile"))
    return join_scores(rows, shares, keys, score, settle)


def rank_stability(rows: DataFrame, keys: list[str], budgets: tuple[int, ...] = BUDGETS, rep: str = "rep", row: str = "row_index") -> DataFrame:
    """(keys, rep_a, rep_b, spearman, jaccard_<budget>...): pairs of repeats, by ordinal ranks and their top sets."""
    ranked = ranked_rows(rows, [*keys, rep]).select(*keys, F.col(rep).alias("rep"), F.col(row).alias("row"), "rn")
    other = ranked.select(*keys, F.col("rep").alias("rep_b"), "row", F.col("rn").alias("rn_b"))
    both = ranked.withColumnsRenamed({"rep": "rep_a", "rn": "rn_a"}).join(other, [*keys, "row"]).where("rep_a < rep_b")
    a, b = F.col("rn_a"), F.col("rn_b")
    jaccard = [divide(F.count_if((a <= k) & (b <= k)), F.count_if((a <= k) | (b <= k))).alias(f"jaccard_{k}") for k in budgets]
    return both.groupBy(*keys, "rep_a", "rep_b").agg(pearson(a.cast("double"), b.cast("double")).alias("spearman"), *jaccard)


def slice_rates(ranked: DataFrame, keys: list[str], group: str, budget: int, least_rows: int = 50, least_positives: int = 3, target: str = "target") -> DataFrame:
    """(keys, group, n_rows, n_pos, selection_rate, recall): small groups are suppressed, recall needs least_positives."""
    top = F.col("rn") <= budget
    cells = ranked.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(target).cast("bigint")).alias("n_pos"), F.count_if(top).alias("k"), F.count_if(top & (F.col(target) == 1)).alias("tp"))
    shown = F.col("n_rows") >= least_rows
    return cells.select(
        *keys, group, "n_rows", "n_pos", F.when(shown, F.col("k") / F.col("n_rows")).alias("selection_rate"), F.when(shown & (F.col("n_pos") >= least_positives), divide(F.col("tp"), F.col("n_pos"))).alias("recall"), (~shown).alias("is_suppressed")
    )
