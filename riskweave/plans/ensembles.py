"""Queries on fits of many groups, calibrators, stacking, blends against single models, and what moves a score."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import ensembles as en
from ..operators import explain as ex
from ..operators import models as ml
from ..operators import ranking as rk
from ..operators import splits as sp
from ..session import cut_lineage
from .fixtures import OOF, WIDE, oof, wide
from .ranking import POINTS, UNIFORM_EDGES, r6
from .registry import Registry

R = Registry()
K = ["model", "rep"]
FEATURES = ["price", "acctbal", "nation", "rare_flag"]


def _newton_sql(steps: int = 14) -> str:
    """Newton's steps of a logistic fit on log odds, one table a step."""
    p = "least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"
    parts = [f", odds AS MATERIALIZED (SELECT model, rep, ln({p} / (1 - {p})) AS z, target::DOUBLE AS y, count(*)::DOUBLE AS n FROM oof GROUP BY ALL)", "it0 AS (SELECT DISTINCT model, rep, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM odds)"]
    for i in range(1, steps + 1):
        parts.append(f"""f{i} AS (SELECT model, rep, a, b, z, y, n, 1 / (1 + exp(-(b + a * z))) AS f FROM odds JOIN it{i - 1} USING (model, rep)),
s{i} AS (SELECT model, rep, a, b, sum(n * (y - f) * z) - 1e-6::DOUBLE * a AS ga, sum(n * (y - f)) AS gb, sum(n * f * (1 - f) * z * z) + 1e-6::DOUBLE AS haa, sum(n * f * (1 - f) * z) AS hab, sum(n * f * (1 - f)) AS hbb FROM f{i} GROUP BY model, rep, a, b),
it{i} AS MATERIALIZED (SELECT model, rep, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{i})""")
    return ", ".join(parts) + f", platt AS (SELECT model, rep, a, b FROM it{steps})\n"


@R.add(OOF + _newton_sql() + "SELECT model, rep, round(a, 5) AS a, round(b, 5) AS b FROM platt")
def platt_fits(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-01, SV-19: the Platt calibrator of every model and repeat, all fit together."""
    return en.platt_fits(oof(spark, folder), K).select(*K, F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@R.add(OOF + _newton_sql() + """, c AS (SELECT model, rep, target, 1 / (1 + exp(-(b + a * ln(least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) / (1 - least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)))))) AS p FROM oof JOIN platt USING (model, rep))
SELECT model, rep, round(avg((p - target) ** 2), 6) AS brier, round(-avg(target * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 5) AS log_loss FROM c GROUP BY ALL""")
def platt_quality(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-03, MET-18: Brier score and log loss after calibration."""
    rows = oof(spark, folder)
    calibrated = rows.join(F.broadcast(en.platt_fits(rows, K)), K).withColumn("score", ml.platt_apply(F.col("score"), F.col("a"), F.col("b")))  # one row a model and repeat
    return rk.probability_quality(calibrated, K).select(*K, *r6("brier"), F.round("log_loss", 5).alias("log_loss"))


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    """(model, method, brier, ece) of raw, Platt and isotonic scores, cross-fitted by fold over all repeats.

    Equal rows are counted in one scan; fits and metrics take the counts.
    """
    rows = cut_lineage(oof(spark, folder).groupBy("model", "fold", "target", "score").agg(F.count(F.lit(1)).alias("n")))
    spread = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("held <> fold")
    fits = en.platt_fits(spread, ["model", "held"], weight="n", settle=cut_lineage).withColumnRenamed("held", "fold")
    parts = [rows.select("model", F.lit("raw").alias("method"), "target", "n", "score")]
    parts.append(rows.join(F.broadcast(fits), ["model", "fold"]).select("model", F.lit("platt").alias("method"), "target", "n", ml.platt_apply(F.col("score"), F.col("a"), F.col("b")).alias("score")))  # 15 rows
    for model in ("m_a", "m_b", "m_c"):
        own = ml.cross_fitted(rows.where(F.col("model") == model), "isotonic", weight="n")
        parts.append(own.select("model", F.lit("isotonic").alias("method"), "target", "n", F.col("calibrated").alias("score")))
    every = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))
    keys = ["model", "method"]
    ece = rk.calibration_error(rk.binned_calibration(every, keys, UNIFORM_EDGES, weight="n"), keys).select(*keys, "ece")
    return cut_lineage(rk.probability_quality(every, keys, weight="n").select(*keys, "brier").join(ece, keys))


@R.add()
def calibration_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-02/03, MET-19: raw, Platt and isotonic scores of every model, cross-fitted."""
    return _methods(spark, folder)


@R.add()
def calibrator_choice(spark: SparkSession, folder: str) -> DataFrame:
    """CAL-04: isotonic only where it improves Brier score and ECE by 2 % each."""
    return en.choose_calibrator(_methods(spark, folder), ["model"])


def _wide_oof(spark: SparkSession, folder: str) -> DataFrame:
    """(rep, row_index, fold, target, log odds of the three models)."""
    rows = oof(spark, folder).groupBy("rep", "row_index", "fold", "target").pivot("model", ["m_a", "m_b", "m_c"]).agg(F.first("score"))
    return rows.select("rep", "row_index", "fold", "target", *(ml.logit(F.col(m)).alias(m) for m in ("m_a", "m_b", "m_c")))


def _stacked(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(en.out_of_fold_logistics(cut_lineage(_wide_oof(spark, folder)), ["rep"], ["m_a", "m_b", "m_c"], 5))


@R.add()
def stacked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-11, EXT-34: out-of-fold scores of a balanced logistic regression on the models' log odds."""
    return _stacked(spark, folder).select("rep", "row_index", F.col("stacked").alias("score"))


@R.add(POINTS + "SELECT rep, count(DISTINCT row_index) AS n, true AS is_complete, true AS beats_best FROM oof GROUP BY rep")
def stacker_gain(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-11/13: whether the stacked scores are complete and rank better than the best single model of each repeat."""
    stacked = _stacked(spark, folder)
    ap = rk.average_precision_roc(rk.ranked_points(stacked, ["rep"], "stacked"), ["rep"]).select("rep", "ap")
    best = rk.average_precision_roc(rk.ranked_points(oof(spark, folder), K), K).groupBy("rep").agg(F.max("ap").alias("best"))
    whole = stacked.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("stacked").between(0, 1)).alias("is_complete"))
    return whole.join(ap, "rep").join(best, "rep").select("rep", "n", "is_complete", (F.col("ap") > F.col("best")).alias("beats_best"))


_BLENDS = POINTS + """
, ord AS (SELECT *, row_number() OVER (PARTITION BY model, rep ORDER BY score, row_index) - 1 AS o, count(*) OVER (PARTITION BY model, rep) AS n FROM oof),
blend AS (SELECT rep, row_index, max(target) AS target, round(avg(score), 9) AS prob_mean, round(avg(o::DOUBLE / (n - 1)), 9) AS rank_mean, round(quantile_cont(o::DOUBLE / (n - 1), 0.5), 9) AS rank_median FROM ord GROUP BY rep, row_index),
bl AS (UNPIVOT blend ON prob_mean, rank_mean, rank_median INTO NAME blend VALUE score),
bp AS (SELECT blend, rep, score, count(*) AS n, sum(target) AS p FROM bl GROUP BY ALL), bc AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM bp WINDOW w AS (PARTITION BY blend, rep ORDER BY score DESC)),
ba AS (SELECT blend, rep, sum(p::DOUBLE * cum_p / cum_n) / sum(p) AS ap FROM bc GROUP BY ALL), best AS (SELECT rep, max(ap) AS best FROM ap GROUP BY rep), gains AS (SELECT blend, ap - best AS gain FROM ba JOIN best USING (rep))
"""


@R.add(_BLENDS + """SELECT blend, count(*) AS n_repeats, round(avg(gain), 6) AS mean_gain, round(avg((gain >= 0)::INT), 6) AS wins, round(min(gain), 6) AS worst_gain, avg(gain) > 0 AND avg((gain >= 0)::INT) >= 0.6 AND min(gain) >= -0.01 AS is_accepted FROM gains GROUP BY blend""")
def blend_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-13, EXT-48: every blend against the best single model of each repeat."""
    rows = oof(spark, folder)
    names = ["prob_mean", "rank_mean", "rank_median"]
    target = rows.where("model = 'm_a'").select("rep", "row_index", "target")
    joined = dec.blends(rows, ["rep"]).select("rep", "row_index", *(F.round(n, 9).alias(n) for n in names)).join(target, ["rep", "row_index"])
    singles = rk.average_precision_roc(rk.ranked_points(rows, K), K)
    out = en.blend_acceptance(joined, singles, names)
    return out.select("blend", "n_repeats", *r6("mean_gain", "wins", "worst_gain"), "is_accepted")


@R.add(OOF + """, r AS (SELECT *, (row_number() OVER (PARTITION BY model, rep ORDER BY score, row_index) - 1)::DOUBLE / (count(*) OVER (PARTITION BY model, rep) - 1) AS pct FROM oof)
SELECT model, row_index, count(*) AS n_seeds, round(avg(score), 6) AS mean_score, round(avg(pct), 6) AS mean_rank, round(stddev_pop(score), 6) AS sd FROM r GROUP BY model, row_index""")
def seed_bag(spark: SparkSession, folder: str) -> DataFrame:
    """ENS-14, EXT-30, NST-09: mean, mean rank and spread of a row's scores over the seeds (here: repeats) of a configuration."""
    return en.seed_bag(rk.ordinal_percentile(oof(spark, folder), K), ["model", "row_index"]).select("model", "row_index", "n_seeds", *r6("mean_score", "mean_rank", "sd"))


_POOLS = {"money": ["price", "acctbal", "price_copy"], "flags": ["rare_flag", "constant", "nation"]}
_ORDER = ["price", "acctbal", "nation", "price_copy", "constant", "rare_flag", "recode", "ident"]


@R.add(WIDE + f""", m AS (SELECT row_index % 3 AS fold, feature, round(avg(value), 6) AS v FROM long WHERE feature <> 'constant' GROUP BY ALL), r AS (SELECT feature, row_number() OVER (PARTITION BY fold ORDER BY v DESC, feature) AS rank FROM m),
p(pool, feature, spot) AS (VALUES {", ".join(f"('{p}', '{f}', {_ORDER.index(f)})" for p, own in _POOLS.items() for f in own)}), mean AS (SELECT feature, avg(rank) AS mean_rank FROM r GROUP BY feature)
SELECT pool, CAST(row_number() OVER (PARTITION BY pool ORDER BY mean_rank NULLS LAST, spot) AS INTEGER) AS place, feature FROM p LEFT JOIN mean USING (feature) QUALIFY place <= 2""")
def pool_columns(spark: SparkSession, folder: str) -> DataFrame:
    """NST-04: the best columns of each pool by mean rank over the folds."""
    from pyspark.sql import Window

    from ..operators import profiling as pf

    long = pf.long_form(wide(spark, folder), [c for c in _ORDER if c != "constant"], ["row_index"])
    means = long.groupBy((F.col("row_index") % 3).alias("fold"), "feature").agg(F.round(F.avg("value"), 6).alias("v"))
    ranks = means.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("v").desc(), "feature")))  # one row a column
    return en.best_of_pool(ranks, _POOLS, 2, _ORDER)


#: A logistic model given by its weights, and the legitimate medians its counterfactuals move to.
_WEIGHTS, _INTERCEPT, _MEDIANS = {"price": 1e-5, "acctbal": -2e-4, "nation": 0.05}, -2.0, {"price": 140_000.0, "acctbal": 4_500.0, "nation": 12.0}


@R.add(WIDE + f""", g AS (SELECT row_index, feature, w, m, coalesce(value, m) AS x FROM long JOIN (VALUES {", ".join(f"('{f}', {w!r}::DOUBLE, {_MEDIANS[f]!r}::DOUBLE)" for f, w in _WEIGHTS.items())}) v(feature, w, m) USING (feature)),
z AS (SELECT row_index, {_INTERCEPT!r}::DOUBLE + sum(w * x) AS z FROM g GROUP BY row_index),
r AS (SELECT row_index, feature, w * (x - m) AS c, CAST(row_number() OVER (PARTITION BY row_index ORDER BY w * (x - m) DESC, feature) AS INTEGER) AS step FROM g WHERE w * (x - m) > 0),
s AS (SELECT row_index, 0 AS step, NULL::VARCHAR AS feature, z AS after FROM z UNION ALL SELECT row_index, step, feature, z - sum(c) OVER (PARTITION BY row_index ORDER BY step) FROM r JOIN z USING (row_index))
SELECT row_index, step, feature, round(1 / (1 + exp(-after)), 6) AS score FROM s""")
def counterfactual_scores(spark: SparkSession, folder: str) -> DataFrame:
    """EX-03: every row's score after its raising features move to the legitimate median, one by one."""
    return ex.counterfactuals(wide(spark, folder), _WEIGHTS, _INTERCEPT, _MEDIANS, 0.3).select("row_index", "step", "feature", *r6("score"))


def _boosted(spark: SparkSession, folder: str):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut_lineage(wide(spark, folder).select("row_index", F.col("target").cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES)))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return GBTClassifier(maxIter=ml.ROUNDS, maxDepth=3, seed=42).fit(ready), ready


@R.add()
def tree_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """EX-01: exact Shapley values of boosted trees for every row and feature."""
    model, rows = _boosted(spark, folder)
    return ex.tree_contributions(model, rows, FEATURES)


@R.add("SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM orders JOIN customer ON o_custkey = c_custkey")
def attribution_sums(spark: SparkSession, folder: str) -> DataFrame:
    """EX-01: rows whose contributions don't add up to the distance of their margin from the mean margin."""
    from pyspark.ml.functions import vector_to_array

    model, rows = _boosted(spark, folder)
    base = sum(2 * w * float(ex._expected(t, ex.np.zeros((1, len(FEATURES))), frozenset())[0]) for w, t in ex.exported_trees(model))
    margin = model.transform(rows).select("row_index", F.element_at(vector_to_array("rawPrediction"), 2).alias("half"))
    sums = ex.tree_contributions(model, rows, FEATURES).groupBy("row_index").agg(F.sum("contribution").alias("got"))
    return margin.join(sums, "row_index").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("got") + base - 2 * F.col("half")) > 1e-6).alias("n_off"))


@R.add()
def global_importance(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-36: mean absolute contribution and share of every feature."""
    model, rows = _boosted(spark, folder)
    return ex.global_importance(ex.tree_contributions(model, rows, FEATURES))


@R.add()
def verifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    """HN-01, EXT-41: out-of-fold scores of trees fit on positives against hard negatives and a background."""
    base = cut_lineage(wide(spark, folder).select("row_index", "target", *FEATURES))
    first = cut_lineage(ml.out_of_fold(base.withColumn("fold", (F.col("row_index") % 3).cast("int")), FEATURES, partial(ml.logistic, l1=0.0), folds=3))
    kinds = sp.hard_negatives(first)
    chosen = cut_lineage(base.join(kinds, "row_index").withColumn("fold", (F.col("row_index") % 3).cast("int")))
    return ml.out_of_fold(chosen, FEATURES, ml.boosted_trees, folds=3).join(kinds, "row_index")
