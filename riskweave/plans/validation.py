"""Queries on nested validation, stress tests, selection and evidence graphs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import models as ml
from ..operators import nested as ne
from ..operators import profiling as pf
from ..operators.splits import shuffle_sql
from ..session import cut_lineage
from .fixtures import GRID, OOF, WIDE, grid, oof, wide
from .ranking import r6
from .registry import Registry

R = Registry()
FEATURES = ["price", "acctbal", "nation", "rare_flag"]


def _rows(spark: SparkSession, folder: str, folds: int = 2) -> DataFrame:
    return cut_lineage(wide(spark, folder).select("row_index", "target", *FEATURES).withColumn("fold", (F.col("row_index") % folds).cast("int")))


@R.add()
def nested_validation(spark: SparkSession, folder: str) -> DataFrame:
    """NST-01..03, 05: outer scores by models chosen on inner folds (3 x 3), from a grid of penalties."""
    candidates = {"ridge": ml.logistic, "strong_ridge": partial(ml.logistic, reg=0.1), "lasso": partial(ml.logistic, l1=1.0, reg=0.001)}
    return ne.nested_scores(_rows(spark, folder, 3), FEATURES, candidates, cut_lineage, outer=3, inner=3)[0]


@R.add()
def selection_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-13, 15, EXT-02: how often a feature is among the best of 40 subsamples."""
    return ne.selection_frequencies(_rows(spark, folder), FEATURES, subsamples=40, top=2)


@R.add()
def selection_optimism(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-17: what choosing features outside the folds adds to the AP."""
    return ne.selection_optimism(_rows(spark, folder, 3), FEATURES, ml.logistic, 2, folds=3)


@R.add()
def fold_importances(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-15: gain of every feature in trees fit without each fold."""
    rows = _rows(spark, folder, 3)
    found = [(f, name, gain) for f in range(3) for name, gain in ne.importances(rows.where(F.col("fold") != f), FEATURES, "gain").items()]
    return spark.createDataFrame(found, "fold int, feature string, gain double")


@R.add()
def positive_removal(spark: SparkSession, folder: str) -> DataFrame:
    """NST-06/07: AP and rank stability when positives are left out of training, in five rounds."""
    return ne.positive_removal(_rows(spark, folder), FEATURES, ml.logistic, rounds=5)


@R.add()
def family_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """NST-08/10, SHD-04: AP without each family of features."""
    return ne.family_dropout(_rows(spark, folder), {"money": ["price", "acctbal"], "place": ["nation"], "flags": ["rare_flag"]}, ml.logistic)


@R.add()
def smote_positives(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-09: synthetic positives between near ones."""
    return ne.smote(_rows(spark, folder), FEATURES, 0.03)


@R.add()
def linear_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """EX-01/02: additive contributions of every row."""
    rows = _rows(spark, folder)
    return ne.linear_contributions(rows, rows, FEATURES)


@R.add()
def feature_stability(spark: SparkSession, folder: str) -> DataFrame:
    """SHD-02: how steady features are from fold to fold."""
    rows = _rows(spark, folder, 3)
    long = pf.long_form(rows, FEATURES, ["row_index", "fold"])
    return ne.feature_stability(long, 3, ne.selection_frequencies(rows, FEATURES, subsamples=40, top=2), ["rare_flag"])


@R.add(OOF + """
, m AS (SELECT model, rep, fold, avg(score) AS v FROM oof GROUP BY ALL), runs AS (SELECT rep * 10 + fold AS run, model, v, row_number() OVER (PARTITION BY rep * 10 + fold ORDER BY v DESC, model) AS r FROM m),
p AS (SELECT a.run AS run_a, b.run AS run_b, a.r AS ra, b.r AS rb FROM runs a JOIN runs b ON a.model = b.model AND a.run < b.run)
SELECT run_a, run_b, round(corr(ra, rb), 6) AS spearman, round(count(*) FILTER (WHERE ra <= 2 AND rb <= 2) / 2, 6) AS overlap FROM p GROUP BY ALL""")
def rank_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """MET-41, EXT-33: agreement of runs in their rankings."""
    m = oof(spark, folder).groupBy("model", (F.col("rep") * 10 + F.col("fold")).alias("run")).agg(F.avg("score").alias("v"))
    return ne.rank_agreement(m, "run", "model", "v", 2).select("run_a", "run_b", *r6("spearman", "overlap"))


@R.add(WIDE + "SELECT target, count(*) AS n_rows, count(DISTINCT nation) AS n_distinct, mode(nation) AS modal_value, round(max(c) / count(*), 6) AS modal_share FROM (SELECT target, nation, count(*) OVER (PARTITION BY target, nation) AS c FROM wide) GROUP BY target".replace("mode(nation)", "arg_max(nation, (c, -nation))"))
def cohort_shape(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-06: how concentrated a class is on a discrete column."""
    counts = wide(spark, folder).groupBy("target", "nation").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("target").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.max_by("nation", F.struct("c", -F.col("nation"))).alias("modal_value"), F.round(F.max("c") / F.sum("c"), 6).alias("modal_share"))


_DRAWN = WIDE + f"""
, n AS (SELECT count(*) FILTER (WHERE target = 0) AS total, count(*) FILTER (WHERE target = 1) AS n_pos FROM wide), d AS (SELECT draw, nation FROM wide, range(200) r(draw), n WHERE target = 0 AND {shuffle_sql('row_index', 'draw + 9000')} < greatest(1, floor(n_pos / total * 2147483647.0::DOUBLE))),
k AS (SELECT draw, nation, count(*) AS n FROM d GROUP BY ALL), shape AS (SELECT CAST(draw AS INTEGER) AS draw, count(*) AS n_distinct, max(n) / sum(n) AS modal_share FROM k GROUP BY draw)
"""


@R.add(_DRAWN + "SELECT draw, n_distinct, round(modal_share, 6) AS modal_share FROM shape")
def concentration_control(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-07: how concentrated 200 draws of the same size are by chance."""
    return _draws(spark, folder).select("draw", "n_distinct", *r6("modal_share"))


def _draws(spark: SparkSession, folder: str) -> DataFrame:
    rows = wide(spark, folder)
    return ne.concentration_control(rows.where("target = 0").select("row_index", F.col("nation").alias("value")), rows.where("target = 1").count(), 200)


@R.add(_DRAWN + """, o AS (SELECT max(c) / sum(c) AS s FROM (SELECT nation, count(*) AS c FROM wide WHERE target = 1 GROUP BY nation))
SELECT count(*) AS n_draws, count(*) FILTER (WHERE modal_share >= s) AS n_as_high, round((count(*) FILTER (WHERE modal_share >= s) + 1) / (count(*) + 1), 6) AS p FROM shape, o""")
def concentration_p(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-07: the empirical p of the positives' own concentration against these draws."""
    counts = wide(spark, folder).where("target = 1").groupBy("nation").agg(F.count(F.lit(1)).alias("c"))
    observed = counts.agg((F.max("c") / F.sum("c")).alias("s")).first()["s"] or 0.0  # one row
    return ne.empirical_p(_draws(spark, folder), float(observed)).select("n_draws", "n_as_high", *r6("p"))


@R.add(GRID + """
, r AS (SELECT round(1 - avg(abs(a - b)), 6) AS consistency FROM (SELECT avg((UPI_AMT_CR_L7D IS NULL)::INT) FILTER (WHERE user_id % 2 = 0) AS a, avg((UPI_AMT_CR_L7D IS NULL)::INT) FILTER (WHERE user_id % 2 = 1) AS b FROM grid UNION ALL
  SELECT avg((ATM_AMT_DB_L7D IS NULL)::INT) FILTER (WHERE user_id % 2 = 0), avg((ATM_AMT_DB_L7D IS NULL)::INT) FILTER (WHERE user_id % 2 = 1) FROM grid))
SELECT least(greatest(consistency, 0), 1) AS consistency FROM r""")
def missing_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-05: how alike two loads are in what they lack."""
    g = pf.long_form(grid(spark, folder), ["UPI_AMT_CR_L7D", "ATM_AMT_DB_L7D"], ["user_id"])
    even = F.col("user_id") % 2 == 0
    gap = g.groupBy("feature").agg(F.abs(F.avg(F.when(even, F.col("value").isNull().cast("double"))) - F.avg(F.when(~even, F.col("value").isNull().cast("double")))).alias("d"))
    return gap.agg(F.least(F.greatest(F.round(1 - F.avg("d"), 6), F.lit(0.0)), F.lit(1.0)).alias("consistency"))


def _graphs(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("row_index")
    reason = lambda name, n, raises: F.struct(F.lit(name).alias("feature"), ((i % n) / 10.0).alias("weight"), raises.alias("raises"))
    doubt = F.array_compact(F.array(F.when(i % 3 == 0, F.struct(F.lit("ood").alias("doubt"), F.lit(0.6).alias("weight")))))
    rows = oof(spark, folder).select("row_index", F.col("score").alias("risk"), F.array(reason("A", 7, i % 2 == 0), reason("B", 5, i % 5 != 0)).alias("reasons"), doubt.alias("doubts"))
    return ev.evidence_graph(rows, "row_index")


@R.add(OOF + """
, s AS (SELECT row_index, score FROM oof)
SELECT relation, count(*) AS n, round(sum(weight), 4) AS weight FROM (
  SELECT CASE WHEN row_index % 2 = 0 THEN 'RAISED_BY' ELSE 'MITIGATED_BY' END AS relation, (row_index % 7) / 10.0::DOUBLE AS weight FROM s UNION ALL SELECT CASE WHEN row_index % 5 <> 0 THEN 'RAISED_BY' ELSE 'MITIGATED_BY' END, (row_index % 5) / 10.0::DOUBLE FROM s
  UNION ALL SELECT 'QUALIFIED_BY', 0.6::DOUBLE FROM s WHERE row_index % 3 = 0 UNION ALL SELECT 'RESULTS_IN', score FROM s) GROUP BY relation""")
def evidence_edges(spark: SparkSession, folder: str) -> DataFrame:
    """EX-08, EXT-62/63: graphs as nested columns, their edges flat again."""
    edges = _graphs(spark, folder).select(F.explode("edges").alias("e"))
    return edges.groupBy("e.relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e.weight"), 4).alias("weight"))


@R.add(OOF + "SELECT count(*) AS n, count(*) AS n_traceable, CAST(sum(4 + (row_index % 3 = 0)::INT) AS BIGINT) AS n_tokens FROM oof")
def evidence_checks(spark: SparkSession, folder: str) -> DataFrame:
    """EX-10/11: every node has a source, every edge its ends; the sources named."""
    g = _graphs(spark, folder)
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(ev.is_traceable(F.col("nodes"), F.col("edges"))).alias("n_traceable"), F.sum(F.size(ev.source_tokens(F.col("nodes"))).cast("bigint")).alias("n_tokens"))


@R.add("""SELECT event_id, CASE WHEN contains(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), 'sent money to') THEN 'sent money to' ELSE '' END AS claims FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SENT_MONEY_TO' WHEN 1 THEN 'sent-money-to x' ELSE 'similar to' END AS t FROM events)""")
def claimed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """EX-13: phrases that a text may not claim, however they are spelled."""
    from ..session import read_table

    m = F.col("event_id") % 3
    t = F.when(m == 0, "SENT_MONEY_TO").when(m == 1, "sent-money-to x").otherwise("similar to")
    return read_table(spark, folder, "events").select("event_id", F.array_join(ev.claims(t, ["sent money to"]), ",").alias("claims"))
