"""Queries that put small operators and whole documents to work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionary as dic
from ..operators import canonical as can
from ..operators import decisions as dec
from ..operators import ensembles as en
from ..operators import evidence as ev
from ..operators import features as ft
from ..operators import firewall as fw
from ..operators import graph as g
from ..operators import models as ml
from ..operators import nested as ne
from ..operators import ranking as rk
from ..operators import resampling as rs
from ..operators import scoring as sc
from ..operators.splits import shuffle_sql
from ..session import cut_lineage, read_table
from ..sources import files
from .features import FACETS, facets
from .fixtures import EDGES, GRID, OOF, WIDE, edges, grid, oof, wide
from .ranking import POINTS, r6
from .registry import Registry

R = Registry()
K = ["model", "rep"]


@R.add()
def table_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01, 03, 24, EXT-70: size and sha256 of every table's files."""
    return files.file_digests(spark, f"{folder}/*.parquet")


@R.add(EDGES + "SELECT account_from, count(*) AS n, round(sum(amount), 4) AS total FROM raw_edges GROUP BY account_from")
def edge_headers(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-07/08: edges under other headers."""
    named = edges(spark, folder).toDF("Sender", "RECEIVER", "Amt", "Txn_Date").withColumn("extra", F.lit(1))
    return g.edge_columns(named).groupBy("account_from").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@R.add(OOF + "SELECT row_index, max(fold) FILTER (WHERE rep = 0) AS rep_0, max(fold) FILTER (WHERE rep = 1) AS rep_1, max(fold) FILTER (WHERE rep = 2) AS rep_2 FROM oof GROUP BY row_index")
def fold_table_wide(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12/13, EXT-21/22/29: folds as columns, made long and wide again."""
    folds = oof(spark, folder).where("model = 'm_a'").groupBy("row_index").pivot("rep", [0, 1, 2]).agg(F.first("fold")).toDF("row_index", "rep_0", "rep_1", "rep_2")
    long = folds.unpivot(["row_index"], ["rep_0", "rep_1", "rep_2"], "rep", "fold")
    return long.groupBy("row_index").pivot("rep", ["rep_0", "rep_1", "rep_2"]).agg(F.first("fold"))


@R.add(OOF + "SELECT model, count(*) AS n, count(*) FILTER (WHERE row_index % 7 = 0) AS n_without_fold FROM oof GROUP BY model")
def fold_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """REL-04, EXT-23: rows whose fold a left join doesn't find."""
    rows = oof(spark, folder)
    folds = rows.where("model = 'm_a' AND row_index % 7 <> 0").select("rep", "row_index", F.col("fold").alias("f"))
    return rows.join(folds, ["rep", "row_index"], "left").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f").isNull()).alias("n_without_fold"))


@R.add("""SELECT c_custkey, (c_acctbal > 0)::INT AS has_balance, CASE WHEN age IS NULL THEN 'NOT_RECORDED' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_group,
'RV-' || c_custkey AS label, c_custkey AS row_again FROM (SELECT *, CASE WHEN c_custkey % 10 <> 0 THEN 18 + c_custkey % 60 END AS age FROM customer)""")
def row_groups_and_labels(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-16..19, EXT-46: binarised values, groups with a bucket for nothing recorded, masked labels and back."""
    k = F.col("c_custkey")
    age = F.when(k % 10 != 0, 18 + k % 60)
    label = sc.row_label(k)
    return read_table(spark, folder, "customer").select("c_custkey", sc.binarised(F.col("c_acctbal")).alias("has_balance"), sc.edge_group(age).alias("age_group"), label.alias("label"), sc.label_row(label).alias("row_again"))


@R.add(OOF + "SELECT model, rep, row_index, 'A=' || (row_index % 9) || '.00 (' || CASE WHEN row_index % 2 = 0 THEN 'raises' ELSE 'lowers' END || '); B=' || (row_index % 5) || '.50 (raises)' AS reasons FROM oof")
def analyst_export(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-10, 13, 14: scores without their label, with their reasons as text."""
    i = F.col("row_index")
    reasons = F.array(F.struct(F.lit("A").alias("feature"), (i % 9).cast("double").alias("value"), (i % 2 == 0).alias("raises")), F.struct(F.lit("B").alias("feature"), (i % 5 + 0.5).cast("double").alias("value"), F.lit(True).alias("raises")))
    rows = oof(spark, folder).drop("target")
    return rows.select(*K, "row_index", F.array_join(F.transform(F.slice(reasons, 1, 2), sc.reason_text), "; ").alias("reasons"))


@R.add("SELECT feature, 'share of ' || lower(variable_name) || ' that is missing' AS gloss FROM feature_registry")
def missing_gloss(spark: SparkSession, folder: str) -> DataFrame:
    """DIC-10: plain words for generated columns."""
    return read_table(spark, folder, "feature_registry").select("feature", F.format_string("share of %s that is missing", F.lower("variable_name")).alias("gloss"))


@R.add(GRID + "SELECT user_id, round(CASE WHEN TOT_TXNAMT_DB_L7D / (abs(TOT_TXNAMT_CR_L7D) + 1e-6) IS NOT NULL THEN least(greatest(TOT_TXNAMT_DB_L7D / (abs(TOT_TXNAMT_CR_L7D) + 1e-6), 0), 100) END, 6) AS MG_PASSTHROUGH_7D, CAST(CASE upper(trim(ACCT_OPN_BUCKET)) WHEN 'G365D' THEN 0 WHEN 'L180D' THEN 1 WHEN 'L31D' THEN 2 WHEN 'L365D' THEN 3 WHEN 'L7D' THEN 4 WHEN 'L90D' THEN 5 WHEN 'UNKNOWN' THEN 6 END AS DOUBLE) AS bucket_code FROM grid")
def model_frame(spark: SparkSession, folder: str) -> DataFrame:
    """FW-06..08, PRJ-04, EXT-04/67/68, POL-10, SIM-29: derived features, the policy's columns, encoded."""
    df = ft.fill_meta(grid(spark, folder)).withColumn("bucket", F.upper(F.trim("ACCT_OPN_BUCKET")))
    fw.assert_clean(df.columns, fw.Policy(hard=("F3912",)))
    coded = can.ordinal_encode(df, can.ordinal_levels(df, "bucket"), "bucket")
    return coded.select("user_id", F.round("MG_PASSTHROUGH_7D", 6).alias("MG_PASSTHROUGH_7D"), F.col("bucket_code").cast("double").alias("bucket_code"))


@R.add(GRID + ", r AS (SELECT feature, avg((value IS NULL)::INT) AS p FROM grid UNPIVOT INCLUDE NULLS (value FOR feature IN (UPI_AMT_CR_L7D, ATM_AMT_DB_L7D, CASH_AMT_CR_L31D, AVG_BAL_31DAYS)) GROUP BY feature) SELECT feature, round(p, 6) AS rate FROM r WHERE p BETWEEN 0.01 AND 0.99")
def missing_flag_fit(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-01: which columns get a flag."""
    rates = ft.missing_rates(grid(spark, folder), ["UPI_AMT_CR_L7D", "ATM_AMT_DB_L7D", "CASH_AMT_CR_L31D", "AVG_BAL_31DAYS"])
    chosen = ft.flag_columns(rates)
    return spark.createDataFrame([(c, round(rates[c], 6)) for c in chosen], "feature string, rate double")


@R.add(WIDE + """, p AS (SELECT feature, value, count(*) AS n, sum(target) AS p FROM long WHERE value IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY feature ORDER BY value DESC) AS cum_p FROM p)
SELECT feature, CASE WHEN count(*) >= 2 THEN round(sum((n - p)::DOUBLE * (cum_p - p / 2.0::DOUBLE)) / (sum(p) * sum(n - p)), 6) END AS auc FROM c GROUP BY feature""")
def safe_auc(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-08, EXT-43: ROC-AUC of single columns, null for constants."""
    from ..operators import profiling as pf
    from .fixtures import WIDE_COLUMNS

    long = pf.long_form(wide(spark, folder), list(WIDE_COLUMNS), ["row_index", "target"])
    return sc.safe_auc(long, ["feature"], "value").select("feature", *r6("auc"))


@R.add(POINTS + """, tk AS (SELECT model, rep, budget, sum(target) FILTER (WHERE rn <= budget) / max(n_pos) AS r FROM ranked, (VALUES (10), (18), (25), (50), (100)) b(budget) GROUP BY ALL),
cells AS (SELECT model, rep, count(*) FILTER (WHERE score >= 0.6 AND target = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= 0.6 AND target = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < 0.6 AND target = 1)::DOUBLE AS fn, count(*) FILTER (WHERE score < 0.6 AND target = 0)::DOUBLE AS tn FROM oof GROUP BY ALL),
doc AS (SELECT model, rep, 'ap' AS metric, ap AS value FROM ap UNION ALL SELECT model, rep, 'roc_auc', roc_auc FROM ap UNION ALL SELECT model, rep, 'recall_at_' || budget, r FROM tk UNION ALL SELECT model, rep, 'precision', tp / (tp + fp) FROM cells UNION ALL SELECT model, rep, 'recall', tp / (tp + fn) FROM cells
  UNION ALL SELECT model, rep, 'f1', 2 * tp / (2 * tp + fn + fp) FROM cells UNION ALL SELECT model, rep, 'mcc', (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) FROM cells
  UNION ALL SELECT model, rep, 'brier', avg((score - target) ** 2) FROM oof GROUP BY model, rep UNION ALL SELECT model, rep, 'log_loss', -avg(target * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) FROM oof GROUP BY model, rep)
SELECT model, rep, metric, round(value, 6) AS value FROM doc""")
def metric_battery(spark: SparkSession, folder: str) -> DataFrame:
    """MET-23, 27, EXT-07, 08, 10, 11, 20, 59: ranking, budget, threshold and probability metrics of every model and repeat as one document."""
    return sc.battery(oof(spark, folder), K, 0.6).select(*K, "metric", *r6("value"))


@R.add(POINTS + """, rr AS (SELECT model, avg(r) AS r FROM (SELECT model, rep, sum(target) FILTER (WHERE rn <= 100) / max(n_pos) AS r FROM ranked GROUP BY ALL) GROUP BY model),
mean AS (SELECT model, row_index, max(target) AS target, round(avg(score), 9) AS s, round(avg(-rn), 6) AS k FROM ranked GROUP BY ALL),
a AS (SELECT model, target, row_number() OVER (PARTITION BY model ORDER BY s DESC, row_index) AS ra, row_number() OVER (PARTITION BY model ORDER BY k DESC, row_index) AS rb FROM mean)
SELECT model, round(any_value(r), 6) AS per_repeat, round(count(*) FILTER (WHERE ra <= 100 AND target = 1) / sum(target), 6) AS score_average, round(count(*) FILTER (WHERE rb <= 100 AND target = 1) / sum(target), 6) AS rank_average FROM a JOIN rr USING (model) GROUP BY model""")
def recall_conventions(spark: SparkSession, folder: str) -> DataFrame:
    """MET-38/39, REL-10, EXT-13, 17, 26, 53: recall at 100 of every model by three conventions."""
    ranked = rk.ranked_rows(oof(spark, folder), K)
    per = rk.at_budgets(ranked, K, (100,)).groupBy("model").agg(F.avg("recall").alias("per_repeat"))
    # ranks are scaled into 0..1, so that their order spreads over the pieces of a ranking
    mean = ranked.groupBy("model", "row_index").agg(F.max("target").alias("target"), F.round(F.avg("score"), 9).alias("s"), F.round(F.avg(1 - (F.col("rn") - 1) / F.col("n_rows")), 12).alias("k"))
    of = lambda c, name: rk.at_budgets(rk.ranked_rows(mean, ["model"], c), ["model"], (100,)).select("model", F.col("recall").alias(name))
    return per.join(of("s", "score_average"), "model").join(of("k", "rank_average"), "model").select("model", *r6("per_repeat", "score_average", "rank_average"))


@R.add(POINTS + "SELECT DISTINCT model, rep, CASE WHEN score >= 0.9 THEN 'at or above CRITICAL_REVIEW' WHEN score >= 0.7 THEN 'between URGENT_REVIEW and CRITICAL_REVIEW' WHEN score >= 0.4 THEN 'between STANDARD_REVIEW and URGENT_REVIEW' ELSE 'below STANDARD_REVIEW' END AS band FROM ranked WHERE rn IN (25, 100, 1000)")
def threshold_bands(spark: SparkSession, folder: str) -> DataFrame:
    """CAP-09: the bands that three budgets' thresholds lie in."""
    ranked = rk.ranked_rows(oof(spark, folder), K).where(F.col("rn").isin(25, 100, 1000))
    return ranked.select(*K, sc.band_of(F.col("score"), F.lit(0.9), F.lit(0.7), F.lit(0.4)).alias("band")).distinct()


@R.add(OOF + "SELECT CASE (row_index % 3 = 0)::INT + ((row_index % 10) / 10.0 < 0.5)::INT + (row_index % 7 = 0)::INT WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n FROM oof GROUP BY 1")
def escalation_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """POL-03, 05, 06: how sure an escalation is."""
    i = F.col("row_index")
    c = sc.escalation_confidence(F.when(i % 3 == 0, "UNCERTAIN_SET").otherwise("LOW_RISK_SET"), (i % 10) / 10.0, i % 7 == 0)
    return oof(spark, folder).groupBy(c.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@R.add(OOF + """, s AS (SELECT model, rep, score, row_number() OVER (PARTITION BY model, rep ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY model, rep) AS n FROM oof)
SELECT model, rep, place, score FROM s, range(101) t(place) WHERE i = floor((n - 1) * place / 100)""")
def reference_grid(spark: SparkSession, folder: str) -> DataFrame:
    """POL-08, EXT-16, UI-03: the scores thinned to 101 points."""
    return sc.thinned_grid(rk.ranked_points(oof(spark, folder), K), K, 101)


@R.add(OOF + """, s AS (SELECT model, rep, cume_dist() OVER (PARTITION BY model, rep ORDER BY score) AS p FROM oof)
SELECT model, rep, CASE WHEN p >= 0.8 THEN 'STRONG' WHEN p >= 0.5 THEN 'SOME' ELSE 'LITTLE' END AS band, count(*) AS n FROM s GROUP BY ALL""")
def percentile_bands(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-40, REL-19: bands by the share of scores at or below."""
    rows = oof(spark, folder).select(*K, "row_index", "score")
    return sc.percentile_band(rows, K, "score", ((0.8, "STRONG"), (0.5, "SOME")), "LITTLE", cut_lineage).groupBy(*K, "band").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"""
WITH k AS (SELECT c_custkey AS row, c_acctbal AS a, c_nationkey AS b, c_custkey % 11 = 0 AS is_positive, r.round FROM customer, range(20) r(round)), h AS (SELECT *, {shuffle_sql('row', 'round + 7')} AS h FROM k),
pr AS (SELECT round, a, b, is_positive, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(is_positive) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY round, h % 256 ORDER BY h, row)),
s AS (SELECT *, 1 - (least(abs(a - a2) / 8000.0::DOUBLE, 1.0::DOUBLE) + (b <> b2)::INT) / 2 AS s FROM pr WHERE a2 IS NOT NULL)
"""


def _random_pairs(spark: SparkSession, folder: str) -> DataFrame:
    c = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"), (F.col("c_custkey") % 11 == 0).alias("is_positive"))
    s = 1 - (F.least(F.abs(F.col("a") - F.col("a_b")) / 8000.0, F.lit(1.0)) + (F.col("b") != F.col("b_b")).cast("double")) / 2
    return sc.random_pairs(c, "row", ["a", "b", "is_positive"], 20, 7).withColumn("value", s)


_NULLS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p995": 0.995}


@R.add(_PAIRS + "SELECT " + ", ".join(f"round(quantile_cont(s, {q}), 6) AS {n}" for n, q in _NULLS.items()) + " FROM s")
def similarity_null(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-05: how close random pairs are."""
    from ..operators.quantiles import linear_quantiles, value_counts

    pairs = _random_pairs(spark, folder).select(F.lit(1).alias("k"), "value")
    return linear_quantiles(value_counts(pairs, ["k"]), ["k"], _NULLS).select(*r6(*_NULLS))


@R.add(_PAIRS + "SELECT " + ", ".join(f"round(quantile_cont(s, {q}), 6) AS {n}" for n, q in _NULLS.items()) + ", round(avg((b = b2)::INT), 6) AS concordance FROM s WHERE NOT is_positive AND NOT p2")
def similarity_null_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-22, EXT-55: the same over pairs of negatives only, and how often chance alone agrees on an attribute."""
    from ..operators.quantiles import linear_quantiles, value_counts

    pairs = _random_pairs(spark, folder).where("NOT is_positive AND NOT is_positive_b").withColumn("k", F.lit(1))
    agree = pairs.agg(F.round(F.avg((F.col("b") == F.col("b_b")).cast("double")), 6).alias("concordance"))
    return linear_quantiles(value_counts(pairs, ["k"]), ["k"], _NULLS).crossJoin(agree).select(*r6(*_NULLS), "concordance")  # one row each


@R.add(WIDE + """, c AS (SELECT feature, round(CASE WHEN isfinite(coalesce(corr(value, target), 'nan'::DOUBLE)) THEN abs(corr(value, target)) ELSE 0 END, 9) AS r FROM long WHERE value IS NOT NULL GROUP BY feature),
head AS (SELECT feature, r AS share FROM c WHERE r >= 0.5), gains AS (SELECT feature, round(r, 9) + 0.001::DOUBLE AS gain FROM c),
w AS (SELECT feature, share / sum(share) OVER () * 0.8::DOUBLE AS w FROM head UNION ALL SELECT feature, gain / sum(gain) OVER () * 0.2::DOUBLE FROM gains WHERE feature NOT IN (SELECT feature FROM head))
SELECT feature, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def fingerprint_weights(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-07, 14: weights of the columns that say most about the label by their share, of the others by gain."""
    from ..operators import profiling as pf
    from .fixtures import WIDE_COLUMNS

    told = pf.label_correlation(pf.long_form(wide(spark, folder), list(WIDE_COLUMNS), ["row_index", "target"])).select("feature", F.round(F.abs("r"), 9).alias("r"))
    head = told.where("r >= 0.5").select("feature", F.col("r").alias("share"))
    return sc.weights_by_share(head, told.select("feature", (F.col("r") + 0.001).alias("gain")), 0.2).select("feature", *r6("weight"))


@R.add(POINTS + "SELECT DISTINCT model FROM ap GROUP BY model HAVING avg(ap) >= 0.4")
def competent_models(spark: SparkSession, folder: str) -> DataFrame:
    """LN-03, EXT-32/35: models above a floor of average precision."""
    m = rk.average_precision_roc(rk.ranked_points(oof(spark, folder), K), K)
    return m.groupBy("model").agg(F.avg("ap").alias("ap")).where("ap >= 0.4").select("model")


@R.add(POINTS + """, fp AS (SELECT model, rep, fold, score, count(*) AS n, sum(target) AS p FROM oof GROUP BY ALL), fc AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM fp WINDOW w AS (PARTITION BY model, rep, fold ORDER BY score DESC)),
fa AS (SELECT model, rep, fold, sum(p::DOUBLE * cp / cn) / nullif(sum(p), 0) AS ap FROM fc GROUP BY ALL),
d AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (WHERE b.ap > a.ap) AS n_up, count(*) FILTER (WHERE b.ap < a.ap) AS n_down FROM fa a JOIN fa b ON a.rep = b.rep AND a.fold = b.fold AND a.model < b.model GROUP BY ALL)
SELECT model_a, model_b, n_up, n_down, round(least(1, 2 * (SELECT sum(factorial(CAST(n_up + n_down AS INTEGER)) / (factorial(i) * factorial(CAST(n_up + n_down - i AS INTEGER)))) FROM (SELECT CAST(unnest(range(0, least(n_up, n_down) + 1)) AS INTEGER) AS i)) / power(2::DOUBLE, n_up + n_down)), 6) AS p FROM d""")
def sign_tests(spark: SparkSession, folder: str) -> DataFrame:
    """ST-01: exact sign test of the fold-wise differences of every pair of models."""
    keys = ["rep", "fold"]
    ap = rk.average_precision_roc(rk.ranked_points(oof(spark, folder), ["model", *keys]), ["model", *keys]).select("model", *keys, "ap")
    pairs = ap.toDF("model_a", *keys, "a").join(ap.toDF("model_b", *keys, "b"), keys).where("model_a < model_b")
    sums = pairs.groupBy("model_a", "model_b").agg(F.count_if(F.col("b") > F.col("a")).alias("n_up"), F.count_if(F.col("b") < F.col("a")).alias("n_down"))
    return sums.withColumn("p", F.round(rs.sign_test_column(F.col("n_up"), F.col("n_down")), 6))


@R.add()
def paired_tests(spark: SparkSession, folder: str) -> DataFrame:
    """ST-02, 04: p values of a fold-wise difference (a row a fold)."""
    keys = ["rep", "fold"]
    ap = rk.average_precision_roc(rk.ranked_points(oof(spark, folder), ["model", *keys]), ["model", *keys])
    d = [r["m_b"] - r["m_a"] for r in ap.groupBy(*keys).pivot("model", ["m_a", "m_b"]).agg(F.first("ap")).collect() if r["m_a"] is not None and r["m_b"] is not None]
    n = len(d)
    mean = sum(d) / n if n else 0.0
    sd = (sum((x - mean) ** 2 for x in d) / (n - 1)) ** 0.5 if n > 1 else 0.0
    up, down = sum(x > 0 for x in d), sum(x < 0 for x in d)
    return spark.createDataFrame([("sign", rs.sign_test(up, down)), ("wilcoxon", rs.wilcoxon(d)), ("t", rs.t_test(mean, sd, n))], "test string, p double")


@R.add(POINTS + """, d AS (SELECT model, (max(ap) - min(ap)) / max(ap) AS drop_, stddev_pop(ap) / avg(ap) AS spread FROM ap GROUP BY model),
pr AS (SELECT a.model, a.rep AS ra, b.rep AS rb, corr(a.rn::DOUBLE, b.rn::DOUBLE) AS c FROM ranked a JOIN ranked b ON a.model = b.model AND a.row_index = b.row_index AND a.rep < b.rep GROUP BY ALL), st AS (SELECT model, min(c) AS steady FROM pr GROUP BY model)
SELECT model, round(drop_, 6) AS relative_drop, round(spread, 6) AS spread, round(steady, 6) AS steady, CASE WHEN drop_ <= 0.15 AND spread <= 0.06 AND steady >= 0.90 THEN 'HIGH' WHEN drop_ <= 0.30 AND spread <= 0.12 AND steady >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM d JOIN st USING (model)""")
def robustness_grades(spark: SparkSession, folder: str) -> DataFrame:
    """NST-11, EXT-52: every model's grade as the worst of its measured drop, spread and rank stability over the repeats."""
    rows = oof(spark, folder)
    ap = rk.average_precision_roc(rk.ranked_points(rows, K), K)
    measured = ap.groupBy("model").agg(((F.max("ap") - F.min("ap")) / F.max("ap")).alias("relative_drop"), (F.stddev_pop("ap") / F.avg("ap")).alias("spread"))
    steady = rk.rank_stability(rows, ["model"]).groupBy("model").agg(F.min("spearman").alias("steady"))
    return ne.robustness_grades(measured.join(steady, "model")).select("model", *r6("relative_drop", "spread", "steady"), "grade")


@R.add()
def scored_batch(spark: SparkSession, folder: str) -> DataFrame:
    """POL-09, SV-05/06, OOF-09: every row scored out of fold and by a fit on all rows, calibrated, with its conformal set, its distribution check and its tier; rows that can't be scored are marked."""
    features = ["price", "acctbal", "nation"]
    median = {"price": 0.0, "acctbal": 0.0, "nation": 0.0}
    spread = {"price": 1e5, "acctbal": 1e3, "nation": 10.0}
    plain = wide(spark, folder).select("row_index", "target", *features, (F.col("row_index") % 5).cast("int").alias("fold"), F.lit(1).alias("k"))
    ready = cut_lineage(plain.select("*", *((F.coalesce(F.col(c), F.lit(median[c])) / spread[c]).alias(f"z_{c}") for c in features)))
    names = [f"z_{c}" for c in features]
    scored = en.out_of_fold_logistics(ready, ["k"], names, 5)
    whole = en.predict_logistics(scored, en.fit_logistics(ready, ["k"], names, 1.0, balanced=True), ["k"], names, "refit")
    base = cut_lineage(whole.withColumn("score", F.col("stacked")))
    fits = en.platt_fits(base, ["k"])
    risk = cut_lineage(base.join(F.broadcast(fits), "k").withColumn("score", ml.platt_apply(F.col("score"), F.col("a"), F.col("b"))).drop("a", "b"))  # one row
    told = risk.join(F.broadcast(dec.conformal_quantiles(risk, ["k"])), "k").join(F.broadcast(dec.tier_thresholds(risk, ["k"])), "k")  # one row each
    conformal = dec.conformal_set(F.col("score"), F.col("q_pos"), F.col("q_neg"))
    from ..operators import drift as dr
    from ..operators import profiling as pf

    seen = dr.out_of_distribution(pf.long_form(plain, features, ["row_index"]).withColumn("is_reference", F.lit(True)), "row_index")
    judged = told.join(seen.select("row_index", "status"), "row_index", "left").withColumn("ood", F.coalesce("status", F.lit("IN_DISTRIBUTION")))
    tier = dec.risk_tier(F.col("score"), F.col("critical_risk"), F.col("urgent_risk"), F.col("standard_risk"), conformal, F.col("ood"), F.lit(None).cast("double"), F.lit(True))
    return judged.select("row_index", F.col("score").alias("risk"), "refit", conformal.alias("conformal"), "ood", tier.alias("tier"), F.when(F.col("score").isNull(), "unreadable").alias("error"))


@R.add(OOF + "SELECT row_index, json_object('model', model, 'rep', rep) AS packet FROM oof")
def evidence_packets(spark: SparkSession, folder: str) -> DataFrame:
    """EX-14: a case as one JSON text."""
    return ev.packet(oof(spark, folder), "row_index", ["model", "rep"])


@R.add(f"WITH o AS (SELECT o_orderkey, {shuffle_sql('o_orderkey', '42')} AS h FROM orders) SELECT o_orderkey FROM o ORDER BY h, o_orderkey LIMIT 400")
def probe_rows(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-58: 400 rows in hash order."""
    return sc.probe_rows(read_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 400)


@R.add("SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id")
def busiest_minute(spark: SparkSession, folder: str) -> DataFrame:
    """SV-09: most requests of a client within 60 seconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    piece = F.floor(t / 60_000_000)
    e = read_table(spark, folder, "events").select("user_id", t.alias("t"), piece.alias("own"), F.explode(F.array(piece, piece + 1)).alias("piece"))
    back = Window.partitionBy("user_id", "piece").orderBy("t").rangeBetween(-60_000_000, 0)
    return e.select("user_id", "own", "piece", F.count(F.lit(1)).over(back).alias("n")).where("own = piece").groupBy("user_id").agg(F.max("n").alias("most"))


@R.add(OOF + "SELECT count(DISTINCT (model, rep)) AS n_runs, max(greatest(score, fold / 10.0::DOUBLE)) AS top, count(*) FILTER (WHERE score < 0.1) AS n_open FROM oof")
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """REL-16, 22: distinct runs, a horizontal maximum, counts by a filter."""
    rows = oof(spark, folder)
    return rows.agg(F.count_distinct(F.struct("model", "rep")).alias("n_runs"), F.max(F.greatest("score", F.col("fold") / 10.0)).alias("top"), F.count_if(F.col("score") < 0.1).alias("n_open"))


@R.add("SELECT rail, list_sort(list(feature)) AS features FROM (SELECT feature, CASE WHEN list_contains(string_split(variable_name, '_'), 'UPI') AND NOT contains(variable_name, 'UPI_XFER') THEN 'UPI' ELSE 'REST' END AS rail FROM feature_registry) GROUP BY rail")
def families(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-14, SPL-07, DIC-07: features of each family."""
    f = read_table(spark, folder, "feature_registry").select("feature", F.when(dic.rail(F.col("variable_name")) == "UPI", "UPI").otherwise("REST").alias("rail"))
    return f.groupBy("rail").agg(F.array_sort(F.collect_list("feature")).alias("features"))  # the registry is a fixed table


@R.add(FACETS + """SELECT feature, variable_name, reason FROM (SELECT feature, variable_name, CASE WHEN feature = 'F0902' THEN 'HARD_QUARANTINE' WHEN availability IN ('TARGET', 'POST_RESOLUTION_LEAKAGE', 'INDEX_OR_ID') THEN 'FORBIDDEN_CLASS'
  WHEN availability <> 'BEHAVIORAL' THEN 'CLASS_NOT_IN_VIEW' END AS reason FROM full_facets) WHERE reason IS NOT NULL""")
def availability_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """FW-05, EXT-05, 61: the columns that a policy refuses, with the grounds."""
    return fw.judge(facets(spark, folder), fw.Policy(hard=("F0902",), allow=("BEHAVIORAL",))).where("reason IS NOT NULL").select("feature", "variable_name", "reason")
