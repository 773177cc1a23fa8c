"""Queries on splits and similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiling as pf
from ..operators import similarity as sim
from ..operators import splits as sp
from ..session import cut_lineage, read_table
from .fixtures import GRID, OOF, grid, oof
from .ranking import r6
from .registry import Registry

R = Registry()

def _hashed(sql: str) -> str:
    """SQL with @H1..@H4 written out: the shuffle hashes of groups, folds and rows."""
    for name, key, seed in (("@H1", "grp", "42"), ("@H2", "grp", "rep + 42"), ("@H3", "row_index", "42"), ("@H4", "row_index", "7")):
        sql = sql.replace(name, sp.shuffle_sql(key, seed))
    return sql


_ORDERS = "WITH o AS (SELECT o_orderkey AS row_index, o_custkey AS grp, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS target FROM orders)\n"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, folder, "orders").select(k.alias("row_index"), F.col("o_custkey").alias("grp"), F.when(k % 97 == 0, 1).otherwise(0).alias("target"))


@R.add("SELECT l_orderkey * 10 + l_linenumber AS row_id, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS group_row FROM lineitem")
def row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-01: rows with equal feature values."""
    df = read_table(spark, folder, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sp.row_groups(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], "row_id")


_HOLD = _ORDERS + _hashed("""
, g AS (SELECT grp, max(target) = 1 AS is_positive, count(*) AS n_rows, @H1 AS h FROM o GROUP BY grp),
hold AS (SELECT grp, is_positive, n_rows, coalesce(sum(n_rows) OVER (PARTITION BY is_positive ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2::DOUBLE * sum(n_rows) OVER (PARTITION BY is_positive) AS is_test FROM g)
""")


def _holdout(spark: SparkSession, folder: str) -> DataFrame:
    return sp.holdout(_orders(spark, folder), "grp", "target", 0.2, 42)


@R.add(_HOLD + "SELECT * FROM hold")
def locked_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-02/03: whole groups held out, by class."""
    return _holdout(spark, folder)


_FOLDS = _HOLD + _hashed(""", folds AS (SELECT grp, rep, CAST((row_number() OVER (PARTITION BY rep, is_positive ORDER BY @H2, grp) - 1) % 5 AS INTEGER) AS fold FROM hold, (VALUES (0), (1), (2), (3), (4)) r(rep) WHERE NOT is_test)\n""")


@R.add(_FOLDS + "SELECT * FROM folds")
def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-04/05: stratified folds of the groups that are not held out."""
    return sp.folds(_holdout(spark, folder).where("NOT is_test"), "grp", 5, 5, 42)


@R.add(_FOLDS + "SELECT (SELECT count(*) FROM (SELECT DISTINCT grp FROM folds) f SEMI JOIN (SELECT grp FROM hold WHERE is_test) t USING (grp)) AS n_shared, true AS is_disjoint")
def split_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-06, REL-07: folds and holdout share no group."""
    hold = _holdout(spark, folder)
    return sp.disjoint(sp.folds(hold.where("NOT is_test"), "grp", 5, 5, 42), hold.where("is_test"), "grp")


@R.add(_FOLDS + "SELECT a.rep AS rep_a, b.rep AS rep_b, round(avg((a.fold = b.fold)::INT), 6) AS same_share FROM folds a JOIN folds b ON a.grp = b.grp AND a.rep < b.rep GROUP BY ALL")
def fold_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-28: share of groups in the same fold of two repeats."""
    f = sp.folds(_holdout(spark, folder).where("NOT is_test"), "grp", 5, 5, 42)
    both = f.toDF("grp", "rep_a", "fold_a").join(f.toDF("grp", "rep_b", "fold_b"), "grp").where("rep_a < rep_b")
    return both.groupBy("rep_a", "rep_b").agg(F.round(F.avg((F.col("fold_a") == F.col("fold_b")).cast("double")), 6).alias("same_share"))


_HARD = OOF + _hashed("""
, s AS (SELECT row_index, target, score FROM oof WHERE model = 'm_a' AND rep = 0), c AS (SELECT quantile_cont(score, 0.98) AS cut FROM s WHERE target = 0),
m AS (SELECT row_index, CASE WHEN score >= cut THEN 'HARD' ELSE 'BACKGROUND' END AS kind FROM s, c WHERE target = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY @H3, row_index) AS n, count(*) FILTER (WHERE kind = 'HARD') OVER () AS n_hard FROM m)
""")


@R.add(_HARD + "SELECT row_index, kind FROM p WHERE kind = 'HARD' OR n <= 3 * n_hard UNION ALL SELECT row_index, 'POSITIVE' FROM s WHERE target = 1")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-08: the highest negatives, a background of others, and the positives."""
    return sp.hard_negatives(oof(spark, folder).where("model = 'm_a' AND rep = 0").select("row_index", "target", "score"))


@R.add(_ORDERS + _hashed(""", n AS (SELECT greatest(1, count(*) FILTER (WHERE target = 0) * 0.05::DOUBLE / count(*) FILTER (WHERE target = 1)) AS rate FROM o)
SELECT target, count(*) AS n FROM (SELECT target, unnest(range(1, 1 + CASE WHEN target = 1 THEN CAST(floor(rate) AS BIGINT) + ((@H4 + 0.5::DOUBLE) / 2147483647.0::DOUBLE < rate - floor(rate))::INT ELSE 1 END)) AS copy_no FROM o, n) GROUP BY target"""))
def random_oversample(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-10: positives repeated to a share of the negatives."""
    return sp.oversample(_orders(spark, folder), 0.05, 7).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@R.add(_ORDERS + _hashed(""", q AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY @H4, row_index) AS k FROM o)
SELECT row_index, grp, target FROM q WHERE target = 1 OR k <= ceil((SELECT count(*) FROM o WHERE target = 1) / 0.1::DOUBLE)"""))
def random_undersample(spark: SparkSession, folder: str) -> DataFrame:
    """SPL-11: negatives dropped until the positives are a share of them."""
    return sp.undersample(_orders(spark, folder), 0.1, 7)


_VEC = """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id AS query, e.vec_id AS row, e.label, round(sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 5) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, row) AS rank FROM d QUALIFY rank <= 10)
"""


def _knn(spark: SparkSession, folder: str) -> DataFrame:
    v = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("v"))
    return sim.topk_in_blocks(v, v.where("row % 50 = 0"), 10, sim.euclidean)


@R.add(_VEC + "SELECT query, max(distance) AS kth_distance, round(avg(distance), 6) AS mean_distance FROM knn GROUP BY query")
def euclid_knn(spark: SparkSession, folder: str) -> DataFrame:
    """OOD-03, REL-21: distance to the tenth neighbour of the query set."""
    return _knn(spark, folder).groupBy("query").agg(F.round(F.max("distance"), 5).alias("kth_distance"), F.round(F.avg(F.round("distance", 5)), 6).alias("mean_distance"))


@R.add(_VEC + """SELECT k.query, (SELECT label FROM embeddings WHERE vec_id = k.query) AS query_label, count(*) FILTER (WHERE k.label = (SELECT label FROM embeddings WHERE vec_id = k.query)) AS n_same, min(distance) FILTER (WHERE k.label = (SELECT label FROM embeddings WHERE vec_id = k.query)) AS nearest_same,
       min(distance) FILTER (WHERE k.label <> (SELECT label FROM embeddings WHERE vec_id = k.query)) AS nearest_other FROM knn k GROUP BY k.query""")
def neighbour_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-26: labels and distances among the nearest."""
    label = read_table(spark, folder, "embeddings").select("vec_id", "label")
    near = _knn(spark, folder).join(label.toDF("row", "label"), "row").join(label.toDF("query", "query_label"), "query")
    same, d = F.col("label") == F.col("query_label"), F.round("distance", 5)
    return near.groupBy("query", "query_label").agg(F.count_if(same).alias("n_same"), F.min(F.when(same, d)).alias("nearest_same"), F.min(F.when(~same, d)).alias("nearest_other"))


@R.add(_VEC + """, j AS (SELECT k.*, CASE WHEN k.label = 3 THEN 1 ELSE 0 END AS y, CASE WHEN (SELECT label FROM embeddings WHERE vec_id = k.query) = 3 THEN 1 ELSE 0 END AS query_label FROM knn k),
p AS (SELECT query_label, query, max(y) AS hit, avg(y) AS share, sum(y) AS n_pos FROM j GROUP BY ALL)
SELECT query_label, count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(share), 6) AS prevalence, round(avg(n_pos), 6) AS mean_positives, round(avg(share) / 0.1::DOUBLE, 6) AS lift FROM p GROUP BY query_label""")
def retrieval_eval(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-19..21: how often the nearest share a label."""
    label = read_table(spark, folder, "embeddings").select("vec_id", F.when(F.col("label") == 3, 1).otherwise(0).alias("label"))
    near = _knn(spark, folder).join(label.toDF("row", "label"), "row").join(label.toDF("query", "query_label"), "query")
    return sim.retrieval_quality(near, 0.1, 10).select("query_label", "n_queries", *r6("hit", "prevalence", "mean_positives", "lift"))


_NUM = ["TOT_TXNAMT_DB_L7D", "TOT_TXNAMT_CR_L31D", "UPI_AMT_CR_L7D", "ATM_AMT_DB_L7D", "AVG_BAL_31DAYS"]
_LONG = f", num AS (SELECT user_id, {', '.join(f'round({c}, 4) AS {c}' for c in _NUM)}, upper(trim(ACCT_OPN_BUCKET)) AS cat FROM grid), nlong AS (FROM num UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_NUM)})))\n"
_FIT = """, fit AS (SELECT feature, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM nlong GROUP BY feature),
frozen AS (SELECT *, CASE WHEN 4 * iqr > 1e-9 THEN 4 * iqr WHEN upper - lower > 1e-9 THEN upper - lower ELSE 1 END AS scale FROM fit)
"""


def _numeric(spark: SparkSession, folder: str) -> DataFrame:
    return grid(spark, folder).select("user_id", *(F.round(c, 4).alias(c) for c in _NUM), F.upper(F.trim("ACCT_OPN_BUCKET")).alias("cat"))


@R.add(GRID + _LONG + _FIT + "SELECT feature, round(median, 6) AS median, round(iqr, 6) AS iqr, round(lower, 6) AS lower, round(upper, 6) AS upper, round(scale, 6) AS scale FROM frozen")
def gower_transform(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-01: bounds and scales of the numeric features."""
    return sim.gower_fit(pf.long_form(_numeric(spark, folder), _NUM, ["user_id"])).select("feature", *r6("median", "iqr", "lower", "upper", "scale"))


_GOWER = GRID + _LONG + _FIT + """
, enc AS (SELECT user_id, feature, CASE WHEN value IS NOT NULL THEN least(greatest(value, lower), upper) END AS v, scale FROM nlong JOIN frozen USING (feature)),
part AS (SELECT a.user_id AS query, b.user_id AS row, sum(CASE WHEN a.v IS NULL AND b.v IS NULL THEN 0 WHEN a.v IS NULL OR b.v IS NULL THEN 1 ELSE least(abs(a.v - b.v) / a.scale, 1) END) AS s FROM enc a JOIN enc b USING (feature) WHERE a.user_id <> b.user_id {who} GROUP BY ALL),
d AS (SELECT query, row, round((s + (x.cat <> y.cat)::INT) / 6, 6) AS distance FROM part JOIN num x ON x.user_id = query JOIN num y ON y.user_id = row),
knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, row) AS rank FROM d QUALIFY rank <= 10)
"""


def _gower(spark: SparkSession, folder: str, with_named: bool = False) -> DataFrame:
    # the transform's few rows (one a feature) are frozen on the driver, as a fitted model is
    wide = cut_lineage(_numeric(spark, folder))
    fit = {r["feature"]: r for r in sim.gower_fit(pf.long_form(wide, _NUM, ["user_id"])).collect()}
    codes = {c: float(i) for i, c in enumerate(sorted({"L7D", "L31D", "L90D", "L180D", "L365D", "G365D", "UNKNOWN"}))}
    nan = F.lit(float("nan"))
    parts = [F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(fit[c]["lower"])), F.lit(fit[c]["upper"]))).otherwise(nan) for c in _NUM]
    code = F.try_element_at(F.create_map(*(F.lit(x) for p in codes.items() for x in p)), F.col("cat"))
    v = wide.select(F.col("user_id").alias("row"), F.array(*parts, F.coalesce(code, F.lit(-1.0))).alias("v"))
    distance = sim.gower_distance(np.full(6, 1 / 6), np.array([fit[c]["scale"] for c in _NUM] + [1.0]), 5)
    rounded = lambda q, r: np.round(distance(q, r), 6)
    first = sim.topk_in_blocks(v, v.where("row % 50 = 0"), 10, rounded)
    if not with_named:
        return first
    first = cut_lineage(first)
    named = v.join(first.select("row").distinct(), "row", "left_semi").where("row % 50 <> 0")
    return first.unionByName(sim.topk_in_blocks(v, named, 10, rounded))


@R.add(_GOWER.format(who="AND a.user_id % 50 = 0") + "SELECT query, row, CAST(rank AS INTEGER) AS rank, distance FROM knn")
def gower_topk(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-02..04, 09, 16..18, 30: the ten most similar accounts of the query set."""
    return _gower(spark, folder).select("query", "row", "rank", "distance")


@R.add(_GOWER.format(who="AND (a.user_id % 50 = 0 OR true)") + "SELECT a.query, a.row FROM knn a JOIN knn b ON a.query = b.row AND a.row = b.query WHERE a.query % 50 = 0")
def gower_mutual(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-10: neighbours of the query set that name it back.

    The lists of the neighbours are needed too, so the named rows are asked as a second query set.
    """
    first = _gower(spark, folder, with_named=True)
    return sim.mutual_edges(first).where("query % 50 = 0")


@R.add(_GOWER.format(who="AND a.user_id % 50 = 0") + """, j AS (SELECT query, (row % 100) / 100.0::DOUBLE AS risk, CASE WHEN row % 4 = 0 THEN 'CRITICAL_REVIEW' WHEN row % 4 = 1 THEN 'URGENT_REVIEW' ELSE 'MONITOR' END AS tier FROM knn)
SELECT query, count(*) AS n_neighbours, count(*) FILTER (WHERE tier <> 'MONITOR') AS n_high_risk, quantile_cont(risk, 0.5) AS median_risk, max(risk) AS max_risk FROM j GROUP BY query""")
def cohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-13: what the neighbours are like."""
    row = F.col("row")
    tier = F.when(row % 4 == 0, "CRITICAL_REVIEW").when(row % 4 == 1, "URGENT_REVIEW").otherwise("MONITOR")
    return sim.cohort_summary(_gower(spark, folder).withColumns({"risk": (row % 100) / 100.0, "tier": tier}))


@R.add(GRID + """, s AS (SELECT user_id, list_filter([CASE WHEN user_id % 2 = 0 THEN 'a' END, CASE WHEN user_id % 3 = 0 THEN 'b' END, CASE WHEN user_id % 5 = 0 THEN 'c' END], lambda x: x IS NOT NULL) AS a, list_filter([CASE WHEN user_id % 7 = 0 THEN 'a' END, CASE WHEN user_id % 3 = 0 THEN 'b' END], lambda x: x IS NOT NULL) AS b FROM grid)
SELECT user_id, coalesce(round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6), 0) AS jaccard FROM s""")
def pattern_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-12: overlap of two sets of patterns."""
    u = F.col("user_id")
    a = F.array_compact(F.array(F.when(u % 2 == 0, "a"), F.when(u % 3 == 0, "b"), F.when(u % 5 == 0, "c")))
    b = F.array_compact(F.array(F.when(u % 7 == 0, "a"), F.when(u % 3 == 0, "b")))
    return grid(spark, folder).select("user_id", F.round(sim.jaccard(a, b), 6).alias("jaccard"))


_POINTS = [(0.0, 0.0), (0.2, 40.0), (0.5, 95.0), (0.8, 99.2), (1.0, 100.0)]


@R.add(GRID + """, s AS (SELECT user_id, (user_id % 101) / 100.0::DOUBLE AS x FROM grid),
p AS (SELECT user_id, CASE WHEN x <= 0 THEN 0 WHEN x <= 0.2 THEN (x - 0) * ((40.0::DOUBLE - 0) / (0.2::DOUBLE - 0)) WHEN x <= 0.5 THEN 40 + (x - 0.2::DOUBLE) * ((95.0::DOUBLE - 40) / (0.5::DOUBLE - 0.2::DOUBLE)) WHEN x <= 0.8 THEN 95 + (x - 0.5::DOUBLE) * ((99.2::DOUBLE - 95) / (0.8::DOUBLE - 0.5::DOUBLE)) ELSE 99.2::DOUBLE + (x - 0.8::DOUBLE) * ((100::DOUBLE - 99.2::DOUBLE) / (1.0::DOUBLE - 0.8::DOUBLE)) END AS pct FROM s)
SELECT user_id, round(pct, 6) AS percentile, CASE WHEN round(pct, 6) >= 99.5 THEN 'VERY_HIGH' WHEN round(pct, 6) >= 99 THEN 'HIGH' WHEN round(pct, 6) >= 95 THEN 'MODERATE' ELSE 'TYPICAL' END AS band FROM p""")
def similarity_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """SIM-06/08, REL-20: interpolated percentile of a similarity, and its band."""
    pct = F.round(sim.interpolated((F.col("user_id") % 101) / 100.0, _POINTS), 6)
    return grid(spark, folder).select("user_id", pct.alias("percentile"), sim.similarity_band(pct).alias("band"))
