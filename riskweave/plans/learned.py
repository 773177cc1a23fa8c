"""Queries on resampling, trained models and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as ml
from ..operators import ranking as rk
from ..operators import resampling as rs
from ..session import cut_lineage
from ..streaming import events as st
from .fixtures import OOF, oof, wide
from .ranking import POINTS, r6
from .registry import Registry

R = Registry()

_METRICS = ["ap", "roc_auc", *(f"tp_{b}" for b in rk.BUDGETS)]


def _replicates(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(rs.replicate_metrics(oof(spark, folder), ["model", "rep"], cut_lineage))


@R.add()
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """MET-22, EXT-06: intervals of ranking metrics and hits at budgets over 2,000 shared draws, by both schemes."""
    return rs.intervals(_replicates(spark, folder), ["model", "rep"], _METRICS)


@R.add(POINTS + f"""
, hits AS (SELECT model, rep, budget, sum(CASE WHEN cum_n <= budget THEN p WHEN cum_n - n < budget THEN (budget - cum_n + n) / n::DOUBLE * p ELSE 0 END) AS tp FROM cum, (VALUES {", ".join(f"({b})" for b in rk.BUDGETS)}) b(budget) GROUP BY ALL),
long AS (SELECT model, rep, 'ap' AS metric, ap AS point FROM ap UNION ALL SELECT model, rep, 'roc_auc', roc_auc FROM ap UNION ALL SELECT model, rep, 'tp_' || budget, tp FROM hits)
SELECT model, rep, scheme, metric, round(point, 6) AS point, true AS is_inside FROM long, (VALUES ('resample_accounts'), ('stratified')) s(scheme)""")
def bootstrap_points(spark: SparkSession, folder: str) -> DataFrame:
    """MET-09, CAP-04: the sample's own metrics by the same machinery, and whether its interval holds them."""
    found = rs.intervals(_replicates(spark, folder), ["model", "rep"], _METRICS)
    return found.select("model", "rep", "scheme", "metric", *r6("point"), F.col("point").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("is_inside"))


@R.add(POINTS + f"""
, spot AS (SELECT model, rep, budget, count(*) FILTER (WHERE rn <= budget AND target = 1) AS tp, max(n_pos) AS n_pos FROM ranked, (VALUES {", ".join(f"({b})" for b in rk.BUDGETS)}) b(budget) GROUP BY ALL)
SELECT model, budget::BIGINT AS budget, round(avg(tp / n_pos), 6) AS recall_mean, round(min(tp / n_pos), 6) AS recall_min, round(max(tp / n_pos), 6) AS recall_max, round(avg(tp / budget), 6) AS precision_mean, true AS has_band FROM spot GROUP BY model, budget""")
def capacity_bands(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-04/06, EXT-27: recall and precision of each budget over the repeats, beside its bootstrap bands."""
    rows = oof(spark, folder)
    spread = rk.at_budgets(rk.ranked_rows(rows, ["model", "rep"]), ["model", "rep"]).groupBy("model", "budget").agg(
        F.avg("recall").alias("recall_mean"), F.min("recall").alias("recall_min"), F.max("recall").alias("recall_max"), F.avg("precision").alias("precision_mean")
    )
    hits = [m for m in _METRICS if m.startswith("tp_")]
    found = rs.intervals(_replicates(spark, folder), ["model", "rep"], hits).where("scheme = 'stratified'").withColumn("budget", F.substring_index("metric", "_", -1).cast("bigint"))
    bands = found.groupBy("model", "budget").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.avg("point").alias("point"))
    held = (F.col("low") <= F.col("point") + 1e-9) & (F.col("point") <= F.col("high") + 1e-9)
    return spread.join(bands, ["model", "budget"]).select("model", "budget", *r6("recall_mean", "recall_min", "recall_max", "precision_mean"), held.alias("has_band"))


@R.add(OOF + """
, pts AS (SELECT model, rep, fold, score, count(*) AS n, sum(target) AS p FROM oof GROUP BY ALL), cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM pts WINDOW w AS (PARTITION BY model, rep, fold ORDER BY score DESC)),
ap AS (SELECT model, rep, fold, sum(p::DOUBLE * cum_p / cum_n) / nullif(sum(p), 0) AS ap FROM cum GROUP BY ALL),
d AS (SELECT b.ap - a.ap AS d FROM ap a JOIN ap b ON a.model = 'm_a' AND b.model = 'm_b' AND a.rep = b.rep AND a.fold = b.fold WHERE b.ap - a.ap IS NOT NULL)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) FILTER (WHERE d > 0) AS n_up, count(*) FILTER (WHERE d < 0) AS n_down, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(d) / sqrt(count(*)), 6) AS detectable FROM d""")
def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    """ST-02/03, MET-33: fold-wise difference of two models."""
    keys = ["rep", "fold"]
    rows = oof(spark, folder)
    ap = rk.average_precision_roc(rk.ranked_points(rows, ["model", *keys]), ["model", *keys])
    wide_ = ap.groupBy(*keys).pivot("model", ["m_a", "m_b"]).agg(F.first("ap"))
    out = rs.paired_sums(wide_, [], "m_a", "m_b").withColumn("detectable", rs.detectable_effect(F.col("sd"), F.col("n")))
    return out.select("n", *r6("mean", "sd"), "n_up", "n_down", *r6("detectable"))


_FEATURES = ["price", "acctbal", "nation", "rare_flag"]


@R.add()
def oof_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    """OOF-01, 05, 07, 08: out-of-fold scores of boosted trees."""
    rows = cut_lineage(wide(spark, folder).withColumn("fold", (F.col("row_index") % 3).cast("int")))
    return ml.out_of_fold(rows, _FEATURES, ml.boosted_trees, folds=3)


@R.add()
def oof_early_stopped(spark: SparkSession, folder: str) -> DataFrame:
    """OOF-06: out-of-fold scores of boosted trees that stop when a fifth of the training rows no longer gains."""
    rows = cut_lineage(wide(spark, folder).withColumn("fold", (F.col("row_index") % 3).cast("int")))
    return ml.out_of_fold(rows, _FEATURES, partial(ml.boosted_trees, rounds=40, validation=0.2), folds=3)


@R.add()
def oof_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """OOF-03/04: out-of-fold scores of a logistic regression."""
    rows = cut_lineage(wide(spark, folder).withColumn("fold", (F.col("row_index") % 3).cast("int")))
    return ml.out_of_fold(rows, _FEATURES, ml.logistic, folds=3)


@R.add()
def load_separability(spark: SparkSession, folder: str) -> DataFrame:
    """SHD-03/05: how well a model tells two loads apart."""
    rows = cut_lineage(wide(spark, folder).select("row_index", *_FEATURES))
    return ml.separability(rows.where("row_index % 2 = 0"), rows.where("row_index % 2 = 1"), _FEATURES, folds=3)


@R.add()
def isolation_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    """ANO-01: isolation-forest scores of every row."""
    rows = wide(spark, folder)
    return ml.isolation_forest(rows, _FEATURES, rows.where("target = 0"), trees=300)


@R.add("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming: event-time day windows with a watermark, as of the last batch."""
    stream = st.windowed_counts(st.event_stream(spark, f"{folder}/event[s].parquet"), ["event_type"], "1 day", late="3650 days")
    table = st.newest_version(st.run_to_table(stream, "daily"), ["event_type", "window_start"])
    return table.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@R.add("SELECT event_id, user_id FROM events")
def stream_unique_events(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming: every event once, however often it arrives."""
    stream = st.event_stream(spark, f"{folder}/event[s].parquet")
    twice = stream.unionByName(st.event_stream(spark, f"{folder}/event[s].parquet"))
    return st.run_to_table(st.unique_events(twice, "event_id", "3650 days").select("event_id", "user_id"), "unique", "append").select("event_id", "user_id")
