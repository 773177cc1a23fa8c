"""Queries on out-of-fold scores: ranking metrics, capacity, conformal sets, blends, label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capacity as cap
from ..operators import decisions as dec
from ..operators import ranking as rk
from ..session import cut_lineage, read_table
from .fixtures import OOF, oof
from .registry import Registry

R = Registry()
K = ["model", "rep"]
#: Edges as the reference's float steps (fixed values).
UNIFORM_EDGES = [i * 0.1 for i in range(10)] + [1.0]
_E = "[" + ", ".join(f"{e!r}::DOUBLE" for e in UNIFORM_EDGES[1:-1]) + "]"


def r6(*names: str):
    """Columns rounded to 6 places: sums differ in the last digits between engines."""
    return [F.round(n, 6).alias(n) for n in names]


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return rk.ranked_points(oof(spark, folder), K)


#: Shared SQL: running totals per distinct score and places per row.
POINTS = OOF + """
, pts AS (SELECT model, rep, score, count(*) AS n, sum(target) AS p FROM oof GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p, sum(n) OVER (PARTITION BY model, rep) AS n_rows, sum(p) OVER (PARTITION BY model, rep) AS n_pos
        FROM pts WINDOW w AS (PARTITION BY model, rep ORDER BY score DESC)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, rep ORDER BY score DESC, row_index) AS rn, count(*) OVER (PARTITION BY model, rep) AS n_rows,
                  sum(target) OVER (PARTITION BY model, rep) AS n_pos FROM oof),
ap AS (SELECT model, rep, CAST(max(n_rows) AS BIGINT) AS n_rows, CAST(max(n_pos) AS BIGINT) AS n_pos, sum(p::DOUBLE * cum_p / cum_n) / max(n_pos) AS ap,
              sum((n - p)::DOUBLE * (cum_p - p / 2.0::DOUBLE)) / (max(n_pos) * max(n_rows - n_pos)) AS roc_auc FROM cum GROUP BY ALL)
"""


@R.add(POINTS + "SELECT model, rep, n_rows, n_pos, round(ap, 6) AS ap, round(roc_auc, 6) AS roc_auc FROM ap")
def ap_roc_per_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """MET-01/02: average precision and ROC-AUC of every model and repeat."""
    return rk.average_precision_roc(_points(spark, folder), K).select(*K, "n_rows", "n_pos", *r6("ap", "roc_auc"))


@R.add(POINTS + "SELECT model, round(avg(ap), 6) AS ap_mean, round(stddev_pop(ap), 6) AS ap_std, round(min(ap), 6) AS ap_min, round(max(ap), 6) AS ap_max, round(avg(roc_auc), 6) AS roc_mean FROM ap GROUP BY model")
def ap_over_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """MET-02: spread of the metrics over repeats."""
    m = rk.average_precision_roc(_points(spark, folder), K)
    out = m.groupBy("model").agg(F.avg("ap").alias("ap_mean"), F.stddev_pop("ap").alias("ap_std"), F.min("ap").alias("ap_min"), F.max("ap").alias("ap_max"), F.avg("roc_auc").alias("roc_mean"))
    return out.select("model", *r6("ap_mean", "ap_std", "ap_min", "ap_max", "roc_mean"))


@R.add(OOF + """
, ranks AS (SELECT model, rep, row_index, target, (row_number() OVER (PARTITION BY model, rep ORDER BY score, row_index) - 1)::DOUBLE / (count(*) OVER (PARTITION BY model, rep) - 1) AS r FROM oof),
mean AS (SELECT model, row_index, max(target) AS target, round(avg(r), 9) AS score FROM ranks GROUP BY ALL),
pts AS (SELECT model, score, count(*) AS n, sum(target) AS p FROM mean GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM pts WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(sum(p::DOUBLE * cum_p / cum_n) / sum(p), 6) AS ap, round(sum((n - p)::DOUBLE * (cum_p - p / 2.0::DOUBLE)) / (sum(p) * sum(n - p)), 6) AS roc_auc FROM cum GROUP BY model""")
def ap_rank_averaged(spark: SparkSession, folder: str) -> DataFrame:
    """MET-03/04: metrics of the mean ordinal rank over repeats."""
    ranks = rk.ordinal_percentile(oof(spark, folder), K)
    mean = ranks.groupBy("model", "row_index").agg(F.max("target").alias("target"), F.round(F.avg("pct_rank"), 9).alias("score"))
    return rk.average_precision_roc(rk.ranked_points(mean, ["model"]), ["model"]).select("model", *r6("ap", "roc_auc"))


_BUDGETS = "(VALUES (10), (18), (25), (50), (100)) b(budget)"
_AT = POINTS + f"""
, topk AS (SELECT model, rep, CAST(b.budget AS BIGINT) AS budget, CAST(least(b.budget, max(n_rows)) AS BIGINT) AS k, CAST(sum(target) FILTER (WHERE rn <= b.budget) AS BIGINT) AS tp,
                CAST(max(n_rows) AS BIGINT) AS n_rows, CAST(max(n_pos) AS BIGINT) AS n_pos FROM ranked, {_BUDGETS} GROUP BY model, rep, b.budget)
"""


def _budgets(spark: SparkSession, folder: str) -> DataFrame:
    return rk.at_budgets(rk.ranked_rows(oof(spark, folder), K), K)


@R.add(_AT + "SELECT model, rep, budget, k, tp, round(tp / n_pos, 6) AS recall, round(tp / k, 6) AS precision FROM topk")
def recall_precision_at_budget(spark: SparkSession, folder: str) -> DataFrame:
    """MET-05: recall and precision of the top rows."""
    return _budgets(spark, folder).select(*K, "budget", "k", "tp", *r6("recall", "precision"))


@R.add(_AT + """
SELECT model, rep, budget, tp, round(least(k, n_pos) / n_pos, 6) AS recall_ceiling, round(k / nullif(tp, 0), 6) AS reviews_per_hit, round((k - tp) * 1000.0::DOUBLE / (n_rows - n_pos), 6) AS fp_per_1000 FROM topk""")
def budget_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """MET-13: what each budget can and does reach."""
    return rk.budget_economics(_budgets(spark, folder)).select(*K, "budget", "tp", *r6("recall_ceiling", "reviews_per_hit", "fp_per_1000"))


@R.add(OOF + """
, cuts AS (SELECT model, rep, 0.005::DOUBLE AS fpr_target, quantile_cont(score, 0.995) FILTER (WHERE target = 0) AS threshold FROM oof GROUP BY ALL
  UNION ALL SELECT model, rep, 0.01::DOUBLE, quantile_cont(score, 0.99) FILTER (WHERE target = 0) FROM oof GROUP BY ALL)
SELECT model, rep, fpr_target, round(threshold, 6) AS threshold, round(count(*) FILTER (WHERE target = 1 AND score >= threshold) / count(*) FILTER (WHERE target = 1), 6) AS recall,
       round(count(*) FILTER (WHERE target = 0 AND score >= threshold) / count(*) FILTER (WHERE target = 0), 6) AS fpr,
       round(count(*) FILTER (WHERE target = 0 AND score >= threshold) * 1000.0::DOUBLE / count(*) FILTER (WHERE target = 0), 6) AS fp_per_1000
FROM oof JOIN cuts USING (model, rep) GROUP BY model, rep, fpr_target, threshold""")
def recall_at_fpr(spark: SparkSession, folder: str) -> DataFrame:
    """MET-06: recall at a false-positive rate."""
    return rk.recall_at_fpr(oof(spark, folder), K).select(*K, "fpr_target", *r6("threshold", "recall", "fpr", "fp_per_1000"))


_ECE = """
, gaps AS (SELECT model, rep, count(*) AS n, abs(avg(score) - avg(target::DOUBLE)) AS gap FROM binned GROUP BY model, rep, bin)
SELECT model, rep, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM gaps GROUP BY ALL"""


@R.add(OOF + f", binned AS (SELECT *, len(list_filter({_E}, lambda e: e <= score)) AS bin FROM oof)" + _ECE)
def ece_uniform(spark: SparkSession, folder: str) -> DataFrame:
    """MET-07: calibration error in uniform, left-closed bins."""
    return rk.calibration_error(rk.binned_calibration(oof(spark, folder), K, UNIFORM_EDGES), K).select(*K, *r6("ece", "mce"))


@R.add(OOF + f", binned AS (SELECT *, len(list_filter({_E}, lambda e: e < score)) AS bin FROM oof)" + _ECE)
def ece_right_closed(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-12: calibration error in uniform, right-closed bins."""
    return rk.calibration_error(rk.binned_calibration(oof(spark, folder), K, UNIFORM_EDGES, right_closed=True), K).select(*K, *r6("ece", "mce"))


@R.add(OOF + """
, q AS (SELECT model, rep, list_distinct(quantile_cont(score, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM oof GROUP BY ALL),
binned AS (SELECT oof.*, len(list_filter(edges, lambda e: e <= score)) AS bin FROM oof JOIN q USING (model, rep))""" + _ECE)
def ece_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """MET-17: calibration error in bins of equal size."""
    rows = oof(spark, folder)
    edges = rows.groupBy(*K).agg(F.array_distinct(F.percentile("score", F.array(*(F.lit(i / 10) for i in range(11))))).alias("edges"))
    return rk.calibration_error(rk.binned_calibration(rows.join(F.broadcast(edges), K), K, F.col("edges")), K).select(*K, *r6("ece", "mce"))  # one row a model and repeat


_CELLS = OOF + """
, cells AS (SELECT model, rep, count(*) FILTER (WHERE score >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND target = 0) AS fp,
                   count(*) FILTER (WHERE score < 0.5 AND target = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND target = 0) AS tn FROM oof GROUP BY ALL)
"""


@R.add(_CELLS + "SELECT * FROM cells")
def confusion_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """MET-08: four cells at a threshold."""
    return rk.confusion(oof(spark, folder), K, 0.5)


@R.add(_CELLS + """
SELECT model, rep, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision,
       round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fn + fp), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2,
       round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(tn / (tn + fn), 6) AS npv, round(fp / (fp + tn), 6) AS fpr,
       round(fn / (fn + tp), 6) AS fnr, round(fp * 1000.0::DOUBLE / (fp + tn), 6) AS fp_per_1000, round((tp + fp) / tp, 6) AS reviews_per_hit FROM cells""")
def threshold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """MET-15/16: metrics of the four cells."""
    names = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "f2", "mcc", "npv", "fpr", "fnr", "fp_per_1000", "reviews_per_hit")
    return rk.confusion_metrics(rk.confusion(oof(spark, folder), K, 0.5)).select(*K, *r6(*names))


@R.add(POINTS + """
, hits AS (SELECT model, rep, rn, n_pos, row_number() OVER (PARTITION BY model, rep ORDER BY rn) AS hit FROM ranked WHERE target = 1)
SELECT model, rep, share, CAST(ceil(n_pos * share - 1e-9) AS BIGINT) AS needed, CAST(rn AS BIGINT) AS alerts FROM hits, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) s(share) WHERE hit = ceil(n_pos * share - 1e-9)""")
def workload_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """MET-14: reviews until a share of the positives is caught."""
    rows = oof(spark, folder)
    return rk.alerts_to_catch(rk.ranked_points(rows, K), K, rk.ranked_rows(rows, K))


@R.add(OOF + """
SELECT model, rep, round(avg((score - target) ** 2), 6) AS brier, round(-avg(target * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))), 6) AS log_loss,
       round(avg(target::DOUBLE) * (1 - avg(target::DOUBLE)), 6) AS base_brier, round(1 - avg((score - target) ** 2) / (avg(target::DOUBLE) * (1 - avg(target::DOUBLE))), 6) AS brier_skill FROM oof GROUP BY ALL""")
def probability_quality(spark: SparkSession, folder: str) -> DataFrame:
    """MET-18: Brier score, log loss and skill."""
    return rk.probability_quality(oof(spark, folder), K).select(*K, *r6("brier", "log_loss", "base_brier", "brier_skill"))


@R.add(POINTS + """
SELECT model, rep, arg_max(score, (round(2 * cum_p / (n_pos + cum_n), 12), score)) AS max_f1_threshold, arg_max(score, (round(5 * cum_p / (4 * n_pos + cum_n), 12), score)) AS max_f2_threshold,
       min(score) FILTER (WHERE cum_p / cum_n >= 0.5) AS precision_threshold, max(score) FILTER (WHERE cum_p / n_pos >= 0.9::DOUBLE) AS recall_threshold FROM cum GROUP BY ALL""")
def threshold_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """MET-20: thresholds of best F1 and F2, of a precision and of a recall."""
    return rk.threshold_families(_points(spark, folder), K)


_TIERS = POINTS + """
, tiers AS (
  SELECT r.model, r.rep, max(score) FILTER (WHERE rn = least(25, r.n_rows)) AS critical_risk, max(score) FILTER (WHERE rn = least(100, r.n_rows)) AS urgent_risk,
         max(standard) AS s FROM ranked r JOIN (
    SELECT model, rep, score AS standard FROM (SELECT model, rep, score, row_number() OVER (PARTITION BY model, rep ORDER BY score, row_index) AS k, count(*) OVER (PARTITION BY model, rep) AS n FROM oof WHERE target = 1)
    WHERE k = floor((1 - 0.9::DOUBLE) * n) + 1) USING (model, rep) GROUP BY ALL),
cuts AS (SELECT model, rep, critical_risk, urgent_risk, least(s, urgent_risk) AS standard_risk FROM tiers)
"""


@R.add(_TIERS + "SELECT * FROM cuts")
def tier_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """POL-02: tier thresholds as order statistics."""
    return dec.tier_thresholds(oof(spark, folder), K)


@R.add(_TIERS + """
SELECT model, rep, tier, threshold, count(*) FILTER (WHERE score >= threshold) AS n_alerts, CAST(coalesce(sum(target) FILTER (WHERE score >= threshold), 0) AS BIGINT) AS tp,
       round(coalesce(sum(target) FILTER (WHERE score >= threshold), 0) / sum(target), 6) AS recall
FROM oof JOIN (UNPIVOT cuts ON critical_risk, urgent_risk, standard_risk INTO NAME tier VALUE threshold) USING (model, rep) GROUP BY model, rep, tier, threshold""")
def locate_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """MET-21, CAP-10: where the tiers' thresholds sit."""
    rows = oof(spark, folder)
    cuts = dec.tier_thresholds(rows, K).unpivot(K, ["critical_risk", "urgent_risk", "standard_risk"], "tier", "threshold")  # three rows a model and repeat
    hit = F.col("score") >= F.col("threshold")
    out = rows.join(F.broadcast(cuts), K).groupBy(*K, "tier", "threshold").agg(F.count_if(hit).alias("n_alerts"), F.count_if(hit & (F.col("target") == 1)).alias("tp"), F.sum("target").alias("P"))
    return out.select(*K, "tier", "threshold", "n_alerts", "tp", F.round(rk.divide(F.col("tp"), F.col("P")), 6).alias("recall"))


@R.add(OOF + """
, pts AS (SELECT model, rep, fold, score, count(*) AS n, sum(target) AS p FROM oof GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM pts WINDOW w AS (PARTITION BY model, rep, fold ORDER BY score DESC))
SELECT model, rep, fold, CAST(sum(n) AS BIGINT) AS n_rows, CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN round(sum(p::DOUBLE * cum_p / cum_n) / sum(p), 6) END AS ap FROM cum GROUP BY ALL""")
def fold_level_ap(spark: SparkSession, folder: str) -> DataFrame:
    """MET-25: average precision inside each fold."""
    keys = [*K, "fold"]
    return rk.average_precision_roc(rk.ranked_points(oof(spark, folder), keys), keys).select(*keys, "n_rows", *r6("ap"))


@R.add(POINTS + """
, pairs AS (SELECT a.model, a.rep AS rep_a, b.rep AS rep_b, a.rn AS ra, b.rn AS rb FROM ranked a JOIN ranked b ON a.model = b.model AND a.row_index = b.row_index AND a.rep < b.rep)
SELECT model, rep_a, rep_b, round(corr(ra::DOUBLE, rb::DOUBLE), 6) AS spearman, """ + ", ".join(f"round(count(*) FILTER (WHERE ra <= {k} AND rb <= {k}) / count(*) FILTER (WHERE ra <= {k} OR rb <= {k}), 6) AS jaccard_{k}" for k in rk.BUDGETS) + " FROM pairs GROUP BY ALL")
def rank_stability(spark: SparkSession, folder: str) -> DataFrame:
    """MET-26/40: rank correlation and overlap of the top sets between repeats."""
    out = rk.rank_stability(oof(spark, folder), ["model"])
    return out.select("model", "rep_a", "rep_b", *r6("spearman", *(f"jaccard_{k}" for k in rk.BUDGETS)))


@R.add(POINTS + """
, r AS (SELECT model, rep, o_orderpriority AS grp, target, rn FROM ranked JOIN orders ON o_orderkey = row_index)
SELECT model, rep, grp, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_pos, CASE WHEN count(*) >= 50 THEN round(count(*) FILTER (WHERE rn <= 100) / count(*), 6) END AS selection_rate,
       CASE WHEN count(*) >= 50 AND sum(target) >= 3 THEN round(count(*) FILTER (WHERE rn <= 100 AND target = 1) / sum(target), 6) END AS recall, count(*) < 50 AS is_suppressed FROM r GROUP BY ALL""")
def slice_fairness(spark: SparkSession, folder: str) -> DataFrame:
    """MET-32: selection rate and recall by group, of every model and repeat."""
    groups = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("grp"))
    ranked = rk.ranked_rows(oof(spark, folder), K).join(groups, "row_index")
    return rk.slice_rates(ranked, K, "grp", 100).select(*K, "grp", "n_rows", "n_pos", *r6("selection_rate", "recall"), "is_suppressed")


_CURVE_SQL = POINTS + """
, one AS (SELECT * FROM ranked WHERE model = 'm_a'),
grid AS (SELECT DISTINCT b AS budget FROM (SELECT unnest(range(1, 301)) AS b UNION ALL SELECT unnest(range(310, 1001, 10)) UNION ALL SELECT unnest(range(1100, (SELECT max(n_rows) + 1 FROM one), 100)) UNION ALL SELECT max(n_rows) FROM one) WHERE b <= (SELECT max(n_rows) FROM one)),
runs AS (SELECT *, sum(target) OVER (PARTITION BY model, rep ORDER BY rn) AS tp, count(*) OVER (PARTITION BY model, rep ORDER BY score DESC) AS n_at FROM one),
curve AS (SELECT rep, CAST(budget AS BIGINT) AS budget, CAST(tp AS BIGINT) AS true_positives, CAST(budget - tp AS BIGINT) AS false_positives, CAST(n_pos - tp AS BIGINT) AS missed, round(tp / n_pos, 6) AS recall,
                 round(tp / budget, 6) AS "precision", round((budget - tp) * 1000.0::DOUBLE / (n_rows - n_pos), 6) AS fp_per_1000_legitimate, round((budget - tp) * 1000.0::DOUBLE / n_rows, 6) AS fp_per_1000_screened,
                 score AS threshold_score, CAST(n_at AS BIGINT) AS n_alerts_at_threshold FROM runs JOIN grid ON budget = rn)
"""


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = oof(spark, folder).where("model = 'm_a'").drop("model")
    n = read_table(spark, folder, "orders").count()
    points, ranked = rk.ranked_points(rows, ["rep"]), rk.ranked_rows(rows, ["rep"])
    out = cap.capacity_curve(ranked, points, ["rep"], cap.budget_grid(spark, n))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "fp_per_1000_legitimate", "fp_per_1000_screened")})


@R.add(_CURVE_SQL + "SELECT * FROM curve")
def capacity_curve(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-01/02: the whole curve."""
    return _curve(spark, folder)


@R.add(POINTS + "SELECT model, rep, CAST(coalesce(min(rn) FILTER (WHERE target = 0) - 1, max(n_rows)) AS BIGINT) AS leading_run FROM ranked GROUP BY ALL")
def leading_run(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-03: positives from the top before the first other row."""
    return cap.leading_run(rk.ranked_rows(oof(spark, folder), K), K)


@R.add(_AT + "SELECT model, budget, round(min(tp / n_pos), 6) AS recall_min, round(max(tp / n_pos), 6) AS recall_max, round(avg(tp / n_pos), 6) AS recall_mean FROM topk GROUP BY ALL")
def per_repeat_recall(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-05: recall over repeats."""
    out = _budgets(spark, folder).groupBy("model", "budget").agg(F.min("recall").alias("recall_min"), F.max("recall").alias("recall_max"), F.avg("recall").alias("recall_mean"))
    return out.select("model", "budget", *r6("recall_min", "recall_max", "recall_mean"))


@R.add(_CURVE_SQL + "SELECT rep, CAST(345 AS BIGINT) AS asked, c.* EXCLUDE (rep) FROM curve c WHERE budget = (SELECT max(budget) FROM curve WHERE budget <= 345)")
def plan_for_budget(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-07: the curve at a budget that may lie between measured ones."""
    return cap.plan_for_budget(_curve(spark, folder), ["rep"], 345)


@R.add(_CURVE_SQL + "SELECT rep, 12.5::DOUBLE AS max_fp_per_1000, c.* EXCLUDE (rep) FROM curve c JOIN (SELECT rep, max(budget) AS budget FROM curve WHERE fp_per_1000_legitimate <= 12.5 GROUP BY rep) USING (rep, budget)")
def plan_for_fp(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-08: the largest budget within a false-alarm tolerance."""
    return cap.plan_for_fp(_curve(spark, folder), ["rep"], 12.5)


_CONFORMAL = OOF + """
, odd AS (SELECT model, rep, target, CASE WHEN target = 1 THEN 1 - score ELSE score END AS s, row_index FROM oof),
placed AS (SELECT *, row_number() OVER (PARTITION BY model, rep, target ORDER BY s, row_index) AS k, count(*) OVER (PARTITION BY model, rep, target) AS n FROM odd),
q AS (SELECT model, rep, max(s) FILTER (WHERE target = 1) AS q_pos, max(s) FILTER (WHERE target = 0) AS q_neg FROM placed WHERE k = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n) GROUP BY ALL),
sets AS (SELECT oof.*, q_pos, q_neg, CASE WHEN 1 - score <= q_pos AND NOT score <= q_neg THEN 'HIGH_RISK_SET' WHEN score <= q_neg AND NOT 1 - score <= q_pos THEN 'LOW_RISK_SET' ELSE 'UNCERTAIN_SET' END AS conformal FROM oof JOIN q USING (model, rep))
"""


@R.add(_CONFORMAL + "SELECT * FROM q")
def conformal_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-05/06: class-wise order statistics."""
    return dec.conformal_quantiles(oof(spark, folder), K)


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = oof(spark, folder)
    named = rows.join(F.broadcast(dec.conformal_quantiles(rows, K)), K)  # one row a model and repeat
    return named.withColumn("conformal", dec.conformal_set(F.col("score"), F.col("q_pos"), F.col("q_neg")))


@R.add(_CONFORMAL + "SELECT model, rep, conformal, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM sets GROUP BY ALL")
def conformal_sets(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-07: how many rows fall into each set."""
    return _sets(spark, folder).groupBy(*K, "conformal").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("n_pos"))


@R.add(_CONFORMAL + """
SELECT model, rep, round(avg((CASE WHEN target = 1 THEN 1 - score <= q_pos ELSE score <= q_neg END)::INT), 6) AS coverage, round(avg((1 - score <= q_pos)::INT) FILTER (WHERE target = 1), 6) AS coverage_pos,
       round(avg((score <= q_neg)::INT) FILTER (WHERE target = 0), 6) AS coverage_neg, round(avg((conformal = 'UNCERTAIN_SET')::INT), 6) AS uncertain_share FROM sets GROUP BY ALL""")
def conformal_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-08: coverage by class and abstention."""
    return dec.conformal_coverage(_sets(spark, folder), K).select(*K, *r6("coverage", "coverage_pos", "coverage_neg", "uncertain_share"))


@R.add(_CONFORMAL.replace("sets AS", "sets0 AS", 1) + _TIERS[len(OOF):].replace(", pts AS", ", pts AS", 1) + """
, given AS (SELECT s.model, s.rep, s.row_index, s.score, s.conformal, critical_risk, urgent_risk, standard_risk, CASE WHEN s.row_index % 53 = 0 THEN 'OUT_OF_DISTRIBUTION' ELSE 'IN_DISTRIBUTION' END AS ood,
                  CASE WHEN s.row_index % 10 <> 0 THEN (s.row_index % 1000) / 10.0::DOUBLE END AS anomaly, s.row_index % 4 <> 0 AS verified FROM sets0 s JOIN cuts USING (model, rep)),
tiered AS (SELECT *, CASE WHEN ood = 'OUT_OF_DISTRIBUTION' THEN 'OOD_REVIEW'
   WHEN score >= critical_risk AND NOT verified AND conformal <> 'HIGH_RISK_SET' THEN 'URGENT_REVIEW' WHEN score >= critical_risk THEN 'CRITICAL_REVIEW' WHEN score >= urgent_risk THEN 'URGENT_REVIEW'
   WHEN score >= standard_risk THEN 'STANDARD_REVIEW' WHEN conformal = 'UNCERTAIN_SET' OR coalesce(anomaly >= 99, false) THEN 'STANDARD_REVIEW' ELSE 'MONITOR' END AS tier FROM given)
SELECT model, rep, tier, count(*) AS n, round(avg(CASE WHEN row_index % 3 = 0 THEN score * 0.85::DOUBLE ELSE score END), 6) AS mean_dampened FROM tiered GROUP BY ALL""")
def policy_decide(spark: SparkSession, folder: str) -> DataFrame:
    """POL-01/04: tiers by precedence, with a bounded dampening of the score."""
    rows = oof(spark, folder)
    named = _sets(spark, folder).join(F.broadcast(dec.tier_thresholds(rows, K)), K)  # one row a model and repeat
    i, c = F.col("row_index"), F.col
    ood = F.when(i % 53 == 0, "OUT_OF_DISTRIBUTION").otherwise("IN_DISTRIBUTION")
    anomaly = F.when(i % 10 != 0, (i % 1000) / 10.0)
    tier = dec.risk_tier(c("score"), c("critical_risk"), c("urgent_risk"), c("standard_risk"), c("conformal"), ood, anomaly, i % 4 != 0)
    out = named.select(*K, tier.alias("tier"), dec.dampened(c("score"), i % 3 == 0).alias("d"))
    return out.groupBy(*K, "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_dampened"))


@R.add(OOF + """
SELECT a.model, a.row_index, round(100.0::DOUBLE * (SELECT count(*) FROM oof b WHERE b.model = a.model AND b.rep = 0 AND b.score <= a.score) / (SELECT count(*) FROM oof b WHERE b.model = a.model AND b.rep = 0), 6) AS percentile
FROM oof a WHERE a.rep = 1 AND a.model = 'm_b'""")
def risk_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """POL-07, ANO-02, EA-03, SIM-28: share of reference scores at or below a score."""
    rows = oof(spark, folder).where("model = 'm_b'")
    out = dec.percentile_of(rows.where("rep = 1").select("model", "row_index", "score"), rows.where("rep = 0").select("model", "score"), ["model"])
    return out.select("model", "row_index", *r6("percentile"))


_RANKS = OOF + """
, ranks AS (SELECT *, row_number() OVER (PARTITION BY model, rep ORDER BY score, row_index) - 1 AS o, count(*) OVER (PARTITION BY model, rep) AS n FROM oof),
blend AS (SELECT rep, row_index, max(target) AS target, avg(score) AS prob_mean, avg(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6)))) AS logit_mean,
                 avg(o::DOUBLE / (n - 1)) AS rank_mean, quantile_cont(o::DOUBLE / (n - 1), 0.5) AS rank_median, CAST(sum(o) AS BIGINT) AS borda FROM ranks GROUP BY rep, row_index)
"""


@R.add(_RANKS + "SELECT rep, row_index, round(prob_mean, 6) AS prob_mean, round(logit_mean, 6) AS logit_mean, round(rank_mean, 6) AS rank_mean, round(rank_median, 6) AS rank_median, borda FROM blend")
def ensemble_blends(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-01..03, 05..07, 12: five ways to join the models' scores."""
    return dec.blends(oof(spark, folder), ["rep"]).select("rep", "row_index", *r6("prob_mean", "logit_mean", "rank_mean", "rank_median"), "borda")


@R.add(POINTS + """
, g AS (SELECT model, rep, greatest(ap - n_pos / n_rows, 0) AS gain FROM ap), w AS (SELECT model, rep, coalesce(gain / nullif(sum(gain) OVER (PARTITION BY rep), 0), 1 / count(*) OVER (PARTITION BY rep)) AS weight FROM g)
SELECT rep, row_index, round(sum(weight * score), 6) AS score FROM oof JOIN w USING (model, rep) GROUP BY rep, row_index""")
def blend_perf_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-04: scores weighted by what each model gains over prevalence."""
    weights = dec.performance_weights(rk.average_precision_roc(_points(spark, folder), K), ["rep"])
    return dec.weighted_blend(oof(spark, folder), F.broadcast(weights), ["rep"]).select("rep", "row_index", *r6("score"))  # one row a model and repeat


@R.add(POINTS + "SELECT rep, arg_max(model, (round(ap, 9), -ascii(right(model, 1)))) AS model, round(max(ap), 6) AS ap FROM ap GROUP BY rep")
def best_single(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-08: the model with the best average precision, ties by name."""
    m = rk.average_precision_roc(_points(spark, folder), K)
    return m.groupBy("rep").agg(F.min_by("model", F.struct(-F.round("ap", 9), "model")).alias("model"), F.round(F.max("ap"), 6).alias("ap"))


@R.add(OOF + """
, g AS (SELECT a, b, 4 - a - b AS c, row_number() OVER (ORDER BY a, b) - 1 AS grid FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4),
mix AS (SELECT rep, grid, row_index, max(target) AS target, round(sum(score * (CASE model WHEN 'm_a' THEN a WHEN 'm_b' THEN b ELSE c END) / 4.0::DOUBLE), 9) AS score FROM oof, g GROUP BY ALL),
pts AS (SELECT rep, grid, score, count(*) AS n, sum(target) AS p FROM mix GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM pts WINDOW w AS (PARTITION BY rep, grid ORDER BY score DESC))
SELECT rep, CAST(grid AS INTEGER) AS grid, round(sum(p::DOUBLE * cum_p / cum_n) / sum(p), 6) AS ap FROM cum GROUP BY rep, grid""")
def blend_simplex(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-09/10: average precision of every blend on a grid of weights."""
    grid = dec.simplex_grid(spark, ["m_a", "m_b", "m_c"], 4)
    rows = oof(spark, folder).join(F.broadcast(grid), "model")  # the grid has 45 rows
    mix = rows.groupBy("rep", "grid", "row_index").agg(F.max("target").alias("target"), F.round(F.sum(F.col("score") * F.col("weight")), 9).alias("score"))
    return rk.average_precision_roc(rk.ranked_points(mix, ["rep", "grid"]), ["rep", "grid"]).select("rep", "grid", *r6("ap"))


_PCT = OOF + """
, pct AS (SELECT *, (rank() OVER (PARTITION BY model, rep ORDER BY score) + (count(*) OVER (PARTITION BY model, rep, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model, rep) * 100 AS percentile FROM oof)
"""


@R.add(_PCT + "SELECT model, rep, row_index, round(percentile, 6) AS percentile FROM pct")
def label_noise_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """LN-01, MET-35, REL-11: average-rank percentile."""
    return rk.average_rank_percentile(oof(spark, folder), K, cut_lineage).select(*K, "row_index", *r6("percentile"))


@R.add(_PCT + """
, rows AS (SELECT row_index, max(target) AS target, avg(percentile) AS mean_percentile, min(percentile) AS min_percentile, max(percentile) AS max_percentile, avg(score) AS mean_score, count(*) AS n_evaluations,
                  avg((percentile <= 50)::INT) AS share_low, avg((percentile >= 99.5)::INT) AS share_high FROM pct GROUP BY row_index)
SELECT row_index, target, round(mean_percentile, 6) AS mean_percentile, round(min_percentile, 6) AS min_percentile, round(max_percentile, 6) AS max_percentile, round(mean_score, 6) AS mean_score, n_evaluations,
       round(share_low, 6) AS share_low, round(share_high, 6) AS share_high, CASE WHEN target = 1 THEN 'POSSIBLE_LABEL_NOISE' ELSE 'HIGH_SCORING_NEGATIVE' END AS flag
FROM rows WHERE target = 1 AND share_low >= 0.1::DOUBLE OR target = 0 AND share_high >= 0.1::DOUBLE""")
def label_noise_audit(spark: SparkSession, folder: str) -> DataFrame:
    """LN-02: rows whose rank contradicts their label in most evaluations."""
    out = dec.label_audit(rk.average_rank_percentile(oof(spark, folder), K, cut_lineage), agreement=0.1)
    return out.select("row_index", "target", *r6("mean_percentile", "min_percentile", "max_percentile", "mean_score"), "n_evaluations", *r6("share_low", "share_high"), "flag")


@R.add(_RANKS + "SELECT rep, row_index FROM ranks WHERE target = 1 GROUP BY rep, row_index HAVING bool_and(o::DOUBLE / (n - 1) < 0.8)")
def noise_flags(spark: SparkSession, folder: str) -> DataFrame:
    """LN-04: positives that every model ranks low."""
    return dec.unanimous_low(rk.ordinal_percentile(oof(spark, folder), K), ["rep"], 0.8)


@R.add(OOF + """
SELECT row_index, rep, max(score) FILTER (WHERE model = 'm_a') AS m_a, max(score) FILTER (WHERE model = 'm_b') AS m_b, max(score) FILTER (WHERE model = 'm_c') AS m_c FROM oof GROUP BY ALL""")
def model_pivot_join(spark: SparkSession, folder: str) -> DataFrame:
    """REL-02/03: the models' scores as columns."""
    return oof(spark, folder).groupBy("row_index", "rep").pivot("model", ["m_a", "m_b", "m_c"]).agg(F.first("score"))


@R.add(OOF + """
, p AS (SELECT rep, row_index, avg(score) AS mean_score, stddev_pop(score) AS sd_score, max(score) - min(score) AS spread FROM oof GROUP BY ALL)
SELECT rep, row_index, round(mean_score, 6) AS mean_score, round(sd_score, 6) AS sd_score, round(spread, 6) AS spread, CASE WHEN spread <= 0.15 THEN 'MODEL_CONSENSUS' WHEN spread <= 0.35 THEN 'PARTIAL_AGREEMENT' ELSE 'MODEL_DISAGREEMENT' END AS status FROM p""")
def disagreement_profile(spark: SparkSession, folder: str) -> DataFrame:
    """EX-04: how far the models disagree."""
    return dec.agreement_profile(oof(spark, folder), ["rep", "row_index"]).select("rep", "row_index", *r6("mean_score", "sd_score", "spread"), "status")


@R.add(OOF + """
, folds AS (SELECT DISTINCT rep, row_index, fold AS outer_fold FROM oof), j AS (SELECT oof.*, outer_fold FROM oof JOIN folds USING (rep, row_index) WHERE model = 'm_c'),
pts AS (SELECT rep, outer_fold, score, count(*) AS n, sum(target) AS p FROM j GROUP BY ALL), cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM pts WINDOW w AS (PARTITION BY rep, outer_fold ORDER BY score DESC))
SELECT rep, outer_fold, CASE WHEN sum(p) > 0 THEN round(sum(p::DOUBLE * cum_p / cum_n) / sum(p), 6) END AS ap FROM cum GROUP BY ALL""")
def fold_join_ap(spark: SparkSession, folder: str) -> DataFrame:
    """ST-05, REL-01: predictions joined to the fold map, then average precision per fold."""
    rows = oof(spark, folder)
    folds = rows.where("model = 'm_a'").select("rep", "row_index", F.col("fold").alias("outer_fold"))
    joined = rows.where("model = 'm_c'").join(folds, ["rep", "row_index"])
    keys = ["rep", "outer_fold"]
    return rk.average_precision_roc(rk.ranked_points(joined, keys), keys).select(*keys, *r6("ap"))


_MISS = """
WITH m AS (SELECT o_orderkey AS row_index, (o_orderkey % 13) / 2.0::DOUBLE AS missingness_z, (o_orderkey % 11) / 10.0::DOUBLE AS missing_fraction, (o_orderkey % 17)::DOUBLE AS knn_distance, 15.0::DOUBLE AS knn_threshold,
                  (o_orderkey % 19) / 80.0::DOUBLE AS range_violation_share, o_orderkey % 400 AS champion_rank, 50 AS budget_k, o_orderkey % 3 AS n_peer_families_within_budget, o_orderkey % 2 AS n_mule_labels_in_neighbourhood,
                  (o_orderkey % 7)::DOUBLE AS distance_to_nearest_legitimate_account, (o_orderkey % 5)::DOUBLE AS distance_to_nearest_known_mule FROM orders WHERE o_orderkey % 97 = 0),
t AS (SELECT row_index, missingness_z >= 4 OR missing_fraction >= 0.5 AS a, knn_distance > knn_threshold OR range_violation_share > 0.2 AS b, champion_rank <= 2 * budget_k AS c, n_peer_families_within_budget >= 1 AS d,
             n_mule_labels_in_neighbourhood = 0 AND distance_to_nearest_legitimate_account < distance_to_nearest_known_mule AS e FROM m)
"""


@R.add(_MISS + """
SELECT row_index, CASE WHEN a THEN 'MISSING_DATA' WHEN b THEN 'OOD_PATTERN' WHEN c THEN 'THRESHOLD_MISS' WHEN d THEN 'MODEL_DISAGREEMENT' WHEN e THEN 'LOOKALIKE_MULE' ELSE 'LOW_SIGNAL_MULE' END AS category,
       concat_ws(',', CASE WHEN a THEN 'MISSING_DATA' END, CASE WHEN b THEN 'OOD_PATTERN' END, CASE WHEN c THEN 'THRESHOLD_MISS' END, CASE WHEN d THEN 'MODEL_DISAGREEMENT' END, CASE WHEN e THEN 'LOOKALIKE_MULE' END) AS fired FROM t""")
def error_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """EA-01: misses by the first rule that holds."""
    return dec.miss_category(_misses(spark, folder)).select("row_index", "category", "fired")


def _misses(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda n, by=1.0: (k % n) / by
    return read_table(spark, folder, "orders").where("o_orderkey % 97 = 0").select(
        k.alias("row_index"), d(13, 2.0).alias("missingness_z"), d(11, 10.0).alias("missing_fraction"), d(17).alias("knn_distance"), F.lit(15.0).alias("knn_threshold"), d(19, 80.0).alias("range_violation_share"),
        (k % 400).alias("champion_rank"), F.lit(50).alias("budget_k"), (k % 3).alias("n_peer_families_within_budget"), (k % 2).alias("n_mule_labels_in_neighbourhood"),
        d(7).alias("distance_to_nearest_legitimate_account"), d(5).alias("distance_to_nearest_known_mule"),
    )


@R.add(POINTS.replace("WITH oof", "WITH " + _MISS.strip()[5:] + ", oof", 1) + """
, missed AS (SELECT model, rep, row_index FROM ranked WHERE target = 1 AND rn > 50)
SELECT model, rep, CASE WHEN a THEN 'MISSING_DATA' WHEN b THEN 'OOD_PATTERN' WHEN c THEN 'THRESHOLD_MISS' WHEN d THEN 'MODEL_DISAGREEMENT' WHEN e THEN 'LOOKALIKE_MULE' ELSE 'LOW_SIGNAL_MULE' END AS category, count(*) AS n FROM missed JOIN t USING (row_index) GROUP BY ALL""")
def error_atlas(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-37: the positives that a budget of 50 misses, by the first rule that explains them, of every model and repeat."""
    missed = rk.ranked_rows(oof(spark, folder), K).where("target = 1 AND rn > 50").select(*K, "row_index")
    named = dec.miss_category(_misses(spark, folder)).select("row_index", "category")
    return missed.join(named, "row_index").groupBy(*K, "category").agg(F.count(F.lit(1)).alias("n"))


@R.add(_MISS + "SELECT round(avg(a::INT), 6) AS missing_data, round(avg(b::INT), 6) AS ood_pattern, round(avg(c::INT), 6) AS threshold_miss, round(avg(d::INT), 6) AS model_disagreement, round(avg(e::INT), 6) AS lookalike_mule FROM t")
def rule_firing_rates(spark: SparkSession, folder: str) -> DataFrame:
    """EA-02: how often each rule holds."""
    fired = dec.miss_category(_misses(spark, folder))
    return fired.agg(*(F.round(F.avg(F.array_contains(F.split("fired", ","), n).cast("double")), 6).alias(n.lower()) for n in dec.MISS_RULES[:-1]))


@R.add(POINTS + """
, topk AS (SELECT rep, sum(target) FILTER (WHERE rn <= 25) / max(n_pos) AS r25, sum(target) FILTER (WHERE rn <= 50) / max(n_pos) AS r50, sum(target) FILTER (WHERE rn <= 100) / max(n_pos) AS r100 FROM ranked WHERE model = 'm_a' GROUP BY rep)
SELECT rep, round(ap, 6) AS ap, round(roc_auc, 6) AS roc_auc, round(r25, 6) AS recall_25, round(r50, 6) AS recall_50, round(r100, 6) AS recall_100 FROM ap JOIN topk USING (rep) WHERE model = 'm_a'""")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Average precision, ROC-AUC and recall at 25, 50 and 100 of one model, per repeat."""
    rows = oof(spark, folder).where("model = 'm_a'").drop("model")
    ap = rk.average_precision_roc(rk.ranked_points(rows, ["rep"]), ["rep"])
    at = rk.at_budgets(rk.ranked_rows(rows, ["rep"]), ["rep"], (25, 50, 100))
    wide = at.groupBy("rep").agg(*(F.round(F.max(F.when(F.col("budget") == b, F.col("recall"))), 6).alias(f"recall_{b}") for b in (25, 50, 100)))
    return ap.select("rep", *r6("ap", "roc_auc")).join(wide, "rep")


@R.add(POINTS + """
, ordered AS (SELECT model, rep, score, cum_n, cum_p, n_rows, n_pos, n, row_number() OVER (PARTITION BY model, rep ORDER BY score) AS i FROM cum),
wanted AS (SELECT model, rep, n_rows, place, floor((n_rows - 1) * place / 199) AS spot FROM (SELECT model, rep, max(n_rows) AS n_rows FROM cum GROUP BY ALL), range(200) t(place))
SELECT w.model, w.rep, CAST(place AS BIGINT) AS place, score AS threshold, round(cum_p / n_pos, 6) AS recall, round(cum_p / cum_n, 6) AS "precision" FROM wanted w JOIN ordered o ON o.model = w.model AND o.rep = w.rep AND o.n_rows - o.cum_n <= spot AND spot < o.n_rows - o.cum_n + o.n""")
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    """MET-10: precision and recall at 200 even steps of the ranking."""
    from ..operators.scoring import thinned_grid

    points = _points(spark, folder)
    totals = points.groupBy(*K).agg(F.max("cum_p").alias("n_pos"))
    placed = thinned_grid(points, K, 200).join(points, [*K, "score"]).join(totals, K)
    return placed.select(*K, "place", F.col("score").alias("threshold"), F.round(F.col("cum_p") / F.col("n_pos"), 6).alias("recall"), F.round(F.col("cum_p") / F.col("cum_n"), 6).alias("precision"))


@R.add(POINTS + """
, b AS (SELECT DISTINCT CAST(unnest([10, 18, 25, 50, 100, floor(n * 0.01::DOUBLE + 0.5), floor(n * 0.02::DOUBLE + 0.5)]) AS BIGINT) AS budget FROM (SELECT count(*) AS n FROM orders))
SELECT model, rep, budget, CAST(count(*) FILTER (WHERE rn <= budget AND target = 1) AS BIGINT) AS tp, round(count(*) FILTER (WHERE rn <= budget AND target = 1) / max(n_pos), 6) AS recall FROM ranked, b GROUP BY ALL""")
def dynamic_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """MET-12: the fixed budgets and one and two per cent of the rows, each once."""
    n = read_table(spark, folder, "orders").count()
    budgets = tuple(sorted({*rk.BUDGETS, int(n * 0.01 + 0.5), int(n * 0.02 + 0.5)}))
    return rk.at_budgets(rk.ranked_rows(oof(spark, folder), K), K, budgets).select(*K, "budget", "tp", *r6("recall"))


@R.add(_TIERS + """
, cells AS (SELECT model, rep, tier, count(*) FILTER (WHERE score >= threshold AND target = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= threshold AND target = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < threshold AND target = 1)::DOUBLE AS fn,
  count(*) FILTER (WHERE score < threshold AND target = 0)::DOUBLE AS tn FROM oof JOIN (UNPIVOT cuts ON critical_risk, urgent_risk, standard_risk INTO NAME tier VALUE threshold) USING (model, rep) GROUP BY ALL)
SELECT model, rep, tier, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM cells""")
def tier_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """MET-24, 28, EXT-09, 54: precision, recall, F1 and MCC at the tiers' thresholds."""
    rows = oof(spark, folder)
    cuts = dec.tier_thresholds(rows, K).unpivot(K, ["critical_risk", "urgent_risk", "standard_risk"], "tier", "threshold")  # three rows a model and repeat
    cells = rk.confusion(rows.join(F.broadcast(cuts), K), [*K, "tier"], F.col("threshold"))
    return rk.confusion_metrics(cells).select(*K, "tier", *r6("precision", "recall", "f1", "mcc"))


@R.add(_AT + """
SELECT model, rep, budget, CAST(tp AS BIGINT) AS tp, CAST(k - tp AS BIGINT) AS fp, CAST(n_pos - tp AS BIGINT) AS fn, CAST(n_rows - n_pos - k + tp AS BIGINT) AS tn, round(tp / k, 6) AS "precision", round(2 * tp / (k + n_pos), 6) AS f1, round((tp + n_rows - n_pos - k + tp) / n_rows, 6) AS accuracy FROM topk""")
def budget_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """MET-29: the four cells and their metrics at each budget, of every repeat."""
    at = _budgets(spark, folder)
    cells = at.select(*K, "budget", "tp", (F.col("k") - F.col("tp")).alias("fp"), (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_rows") - F.col("n_pos") - F.col("k") + F.col("tp")).alias("tn"))
    return rk.confusion_metrics(cells).select(*K, "budget", "tp", "fp", "fn", "tn", *r6("precision", "f1", "accuracy"))


@R.add(POINTS + """, long AS (SELECT model, 'ap' AS metric, ap AS value FROM ap UNION ALL SELECT model, 'roc_auc', roc_auc FROM ap UNION ALL SELECT model, 'brier', avg((score - target) ** 2) FROM oof GROUP BY model, rep)
SELECT model, metric, count(*) AS n_repeats, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM long GROUP BY ALL""")
def pooled_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-18: mean and deviation of the metrics over the repeats."""
    rows = oof(spark, folder)
    long = rk.average_precision_roc(rk.ranked_points(rows, K), K).unpivot(K, ["ap", "roc_auc"], "metric", "value").unionByName(rk.probability_quality(rows, K).unpivot(K, ["brier"], "metric", "value"))
    return long.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n_repeats"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
