"""Queries on wide tables: profile, leakage audit, drift, out-of-distribution, preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import profiling as pf
from ..operators.quantiles import linear_quantiles, value_counts
from ..session import cut_lineage
from .fixtures import GRID, WIDE, WIDE_COLUMNS, grid, wide
from .ranking import r6
from .registry import Registry

R = Registry()
COLS = list(WIDE_COLUMNS)


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return pf.long_form(wide(spark, folder), COLS, ["row_index", "target"])


_Q = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


@R.add(WIDE + """
, counts AS (SELECT feature, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
tops AS (SELECT feature, arg_max(value, (n, -value)) AS top_value, max(n) AS top_n, count(*) AS n_unique FROM counts GROUP BY feature),
agg AS (SELECT feature, count(*) AS n_rows, count(value) AS n_valued, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS std, count(*) FILTER (WHERE value = 0) AS zeros, bool_and(value = floor(value)) FILTER (WHERE value IS NOT NULL) AS is_integer,
  """ + ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in _Q.items()) + """ FROM long GROUP BY feature)
SELECT feature, n_rows, n_rows - n_valued AS n_missing, round(1 - n_valued / n_rows, 6) AS missing_rate, n_unique, n_unique <= 1 AS is_constant, top_value, round(top_n / n_valued, 6) AS top_share,
       n_unique <= 1 OR top_n / n_valued >= 0.99 OR 1 - n_valued / n_rows >= 0.99 AS is_quasi_constant, round(zeros / n_valued, 6) AS zero_rate, low, high, round(mean, 4) AS mean, round(std, 4) AS std, """ + ", ".join(f"round({n}, 6) AS {n}" for n in _Q) + ", is_integer FROM agg JOIN tops USING (feature)")
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-01/03: the profile of every column."""
    p = pf.profile_columns(wide(spark, folder), COLS, cut_lineage)
    return p.select("feature", "n_rows", "n_missing", *r6("missing_rate"), "n_unique", "is_constant", "top_value", *r6("top_share"), "is_quasi_constant", *r6("zero_rate"), "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *r6(*_Q), "is_integer")


@R.add(WIDE + "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS place, value, n FROM (SELECT feature, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL) QUALIFY place <= 5")
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-01, REL-15: the five most frequent values of every column."""
    return pf.top_values(_long(spark, folder))


def _dup_sql() -> str:
    rows = []
    for i, c in enumerate(COLS):
        tests = " ".join(f"WHEN (SELECT count(*) FROM wide WHERE {c} IS DISTINCT FROM {d}) = 0 THEN '{d}'" for d in COLS[:i])
        rows.append(f"SELECT '{c}' AS feature, {'CASE ' + tests + ' END' if tests else 'NULL::VARCHAR'} AS duplicate_of")
    return WIDE + " UNION ALL ".join(rows)


@R.add(_dup_sql())
def duplicate_columns(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-02: columns with the content of an earlier one."""
    return pf.duplicate_columns(wide(spark, folder), COLS, "row_index")


@R.add(WIDE + "SELECT feature, count(value) AS n, round(CASE WHEN count(value) < 10 OR NOT isfinite(coalesce(corr(value, target), 'nan'::DOUBLE)) THEN 0 ELSE corr(value, target) END, 6) AS r FROM long WHERE value IS NOT NULL GROUP BY feature")
def pointbiserial(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-05: correlation of each column with the label."""
    return pf.label_correlation(_long(spark, folder)).select("feature", "n", *r6("r"))


@R.add(WIDE + """
, e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges, count(DISTINCT value) <= 1 AS flat FROM long GROUP BY feature),
b AS (SELECT feature, target, CASE WHEN value IS NULL THEN 0 WHEN flat THEN 1 ELSE 1 + len(list_filter(edges, lambda x: x <= value)) END AS bin FROM long JOIN e USING (feature)),
c AS (SELECT feature, bin, target, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
t AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * log2(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, bin) * sum(n) OVER (PARTITION BY feature, target))) AS t FROM c)
SELECT feature, round(greatest(0, least(sum(t), (SELECT -(avg(target) * log2(avg(target)) + (1 - avg(target)) * log2(1 - avg(target))) FROM wide))), 6) AS mi_bits FROM t GROUP BY feature""")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-07: information of each column about the label."""
    return pf.mutual_information(_long(spark, folder)).select("feature", *r6("mi_bits"))


@R.add(WIDE + """
, l AS (SELECT feature, value, count(*) AS n, sum(target) AS p FROM long WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT feature, count(*) AS k, sum(p) AS pos, sum(n - p) AS neg, coalesce(sum(p) FILTER (WHERE p / n >= 0.5), 0) AS tp, coalesce(sum(n - p) FILTER (WHERE p / n < 0.5), 0) AS tn FROM l GROUP BY feature)
SELECT feature, round(CASE WHEN k BETWEEN 2 AND 25 AND pos > 0 AND neg > 0 THEN (tp / pos + tn / neg) / 2 ELSE 0 END, 6) AS rate FROM s""")
def label_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-08: how well a column's values name the label."""
    return pf.label_reconstruction(_long(spark, folder)).select("feature", *r6("rate"))


_SINGLE = WIDE + """
, f AS (SELECT *, row_index % 5 AS fold FROM long), held AS (SELECT f.*, h.held FROM f, (VALUES (0), (1), (2), (3), (4)) h(held)),
med AS (SELECT feature, held, quantile_cont(value, 0.5) AS median FROM held WHERE fold <> held GROUP BY ALL),
v AS (SELECT feature, held, fold = held AS is_held, target, coalesce(value, median, 0) AS v FROM held LEFT JOIN med USING (feature, held)),
w AS (SELECT feature, held, is_held, target, way, CASE way WHEN 'up' THEN v ELSE -v END AS s FROM v, (VALUES ('up'), ('down')) x(way)),
pts AS (SELECT feature, held, is_held, way, s, count(*) AS n, sum(target) AS p FROM w GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER z AS cum_n, sum(p) OVER z AS cum_p FROM pts WINDOW z AS (PARTITION BY feature, held, is_held, way ORDER BY s DESC)),
m AS (SELECT feature, held, is_held, way, sum(p::DOUBLE * cum_p / cum_n) / sum(p) AS ap, sum((n - p)::DOUBLE * (cum_p - p / 2.0::DOUBLE)) / (sum(p) * sum(n - p)) AS auc FROM cum GROUP BY ALL),
best AS (SELECT feature, held, arg_max(way, (round(ap, 12), way)) AS way FROM m WHERE NOT is_held GROUP BY ALL),
single AS (SELECT feature, avg(ap) AS ap, avg(auc) AS auc FROM m JOIN best USING (feature, held, way) WHERE is_held GROUP BY feature)
"""


def _single(spark: SparkSession, folder: str) -> DataFrame:
    return pf.column_scores(wide(spark, folder).withColumn("fold", F.col("row_index") % 5), COLS, 5)


@R.add(_SINGLE + "SELECT feature, round(ap, 6) AS ap, round(auc, 6) AS auc FROM single")
def single_feature_ap(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-06: held-out ranking by each column alone."""
    return _single(spark, folder).select("feature", *r6("ap", "auc"))


@R.add(_SINGLE + """
, agg AS (SELECT feature, count(*) AS n_rows, count(DISTINCT value) AS n_unique, bool_and(value = floor(value)) FILTER (WHERE value IS NOT NULL) AS is_integer, corr(value, target) AS r FROM long GROUP BY feature),
l AS (SELECT feature, value, count(*) AS n, sum(target) AS p FROM long WHERE value IS NOT NULL GROUP BY ALL),
rec AS (SELECT feature, CASE WHEN count(*) BETWEEN 2 AND 25 THEN (coalesce(sum(p) FILTER (WHERE p / n >= 0.5), 0) / sum(p) + coalesce(sum(n - p) FILTER (WHERE p / n < 0.5), 0) / sum(n - p)) / 2 ELSE 0 END AS rate FROM l GROUP BY feature)
SELECT feature, concat_ws(',', CASE WHEN isfinite(r) AND abs(r) >= 0.95 THEN 'high_correlation' END, CASE WHEN ap >= 0.9 THEN 'high_single_ap' END, CASE WHEN rate >= 0.95 THEN 'label_reconstruction' END, CASE WHEN auc >= 0.999 OR auc <= 0.001 THEN 'extreme_auc' END,
       CASE WHEN is_integer AND n_unique / n_rows >= 0.98 AND n_unique > 1000 THEN 'identifier_like' END) AS flags FROM agg JOIN single USING (feature) JOIN rec USING (feature)""")
def leakage_flags(spark: SparkSession, folder: str) -> DataFrame:
    """PROF-09, FW-09: columns that may give the label away, with the grounds."""
    long = _long(spark, folder)
    return pf.leakage_flags(pf.profile_columns(wide(spark, folder), COLS, cut_lineage), pf.label_correlation(long), _single(spark, folder), pf.label_reconstruction(long))


@R.add(WIDE + """
, q AS (SELECT feature, quantile_cont(value, 0.5) AS med, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-12 THEN 1 ELSE stddev_pop(value) END AS std FROM long GROUP BY feature)
SELECT row_index, feature, round((coalesce(value, med) - mean) / std, 5) AS z FROM long JOIN q USING (feature) WHERE feature IN ('price', 'acctbal', 'nation')""")
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    """PRE-01/02, SPL-12: median-filled, standardised columns."""
    long = _long(spark, folder).where(F.col("feature").isin("price", "acctbal", "nation"))
    counts = value_counts(long, ["feature"])
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s")).join(linear_quantiles(counts, ["feature"], {"med": 0.5}), "feature")
    std = F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s"))
    return long.join(stats, "feature").select("row_index", "feature", F.round((F.coalesce("value", "med") - F.col("mean")) / std, 5).alias("z"))


@R.add(WIDE + """
, agg AS (SELECT feature, count(DISTINCT value) AS k FROM long GROUP BY feature)
SELECT feature, NOT (k <= 1 OR feature = 'price_copy') AS is_kept, CASE WHEN k <= 1 THEN 'CONSTANT' WHEN feature = 'price_copy' THEN 'DUPLICATE' END AS reason FROM agg""")
def preprocess_keep(spark: SparkSession, folder: str) -> DataFrame:
    """PRE-01: constants and repeats of earlier columns are dropped."""
    df = wide(spark, folder)
    levels = _long(spark, folder).groupBy("feature").agg(F.count_distinct("value").alias("k"))
    reason = F.when(F.col("k") <= 1, "CONSTANT").when(F.col("duplicate_of").isNotNull(), "DUPLICATE")
    return levels.join(pf.duplicate_columns(df, COLS, "row_index"), "feature").select("feature", reason.isNull().alias("is_kept"), reason.alias("reason"))


_G = ["TOT_TXNAMT_DB_L7D", "TOT_TXNAMT_CR_L31D", "UPI_AMT_CR_L7D", "ATM_AMT_DB_L7D", "AVG_BAL_31DAYS"]
_GLONG = GRID + f", sided AS (SELECT user_id, user_id % 2 = 0 AS is_reference, {', '.join(f'round({c}, 4) AS {c}' for c in _G)} FROM grid), glong AS (FROM sided UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_G)})))\n"


def _glong(spark: SparkSession, folder: str) -> DataFrame:
    g = grid(spark, folder).select("user_id", (F.col("user_id") % 2 == 0).alias("is_reference"), *(F.round(c, 4).alias(c) for c in _G))
    return pf.long_form(g, _G, ["user_id", "is_reference"])


_PSI_TAIL = """
, grid2 AS (SELECT feature, unnest(range(n_bins)) AS bin, ta, tb FROM (SELECT feature, max(n_bins) AS n_bins, count(*) FILTER (WHERE is_reference AND bin IS NOT NULL) AS ta, count(*) FILTER (WHERE NOT is_reference AND bin IS NOT NULL) AS tb FROM binned GROUP BY feature)),
props AS (SELECT g.feature, greatest(count(b.bin) FILTER (WHERE b.is_reference) / greatest(max(ta), 1), 1e-6) AS p, greatest(count(b.bin) FILTER (WHERE NOT b.is_reference) / greatest(max(tb), 1), 1e-6) AS q FROM grid2 g LEFT JOIN binned b ON g.feature = b.feature AND g.bin = b.bin GROUP BY g.feature, g.bin),
psi AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM props GROUP BY feature)
"""
_OPEN = _GLONG + """, e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM glong WHERE is_reference GROUP BY feature HAVING count(value) >= 20 AND count(DISTINCT value) > 1),
binned AS (SELECT feature, is_reference, len(edges) + 1 AS n_bins, len(list_filter(edges, lambda x: x <= value)) AS bin FROM glong JOIN e USING (feature) WHERE value IS NOT NULL)""" + _PSI_TAIL
_CLOSED = _GLONG + """, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM glong WHERE is_reference GROUP BY feature),
binned AS (SELECT feature, is_reference, len(edges) - 1 AS n_bins, CASE WHEN value BETWEEN edges[1] AND edges[-1] THEN least(len(list_filter(edges, lambda x: x <= value)), len(edges) - 1) - 1 END AS bin FROM glong JOIN e USING (feature) WHERE value IS NOT NULL)""" + _PSI_TAIL + """
, sizes AS (SELECT feature, count(value) FILTER (WHERE is_reference) >= 20 AND count(value) FILTER (WHERE NOT is_reference) >= 20 AS fit FROM glong GROUP BY feature)
"""


@R.add(_OPEN + "SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_drift(spark: SparkSession, folder: str) -> DataFrame:
    """DRF-01..03: stability index with open outer bins."""
    return dr.psi_open(_glong(spark, folder)).select("feature", *r6("psi"))


@R.add(_CLOSED + "SELECT s.feature, round(CASE WHEN fit AND len(edges) >= 3 THEN psi ELSE 0 END, 6) AS psi FROM sizes s JOIN e USING (feature) LEFT JOIN psi USING (feature)")
def psi_shield(spark: SparkSession, folder: str) -> DataFrame:
    """SHD-01: stability index within the reference's range."""
    return dr.psi_closed(_glong(spark, folder)).select("feature", *r6("psi"))


_REPORT = _OPEN + """, report AS (SELECT feature, psi, (avg((value IS NULL)::INT) FILTER (WHERE NOT is_reference)) - (avg((value IS NULL)::INT) FILTER (WHERE is_reference)) AS missing_shift,
  CASE WHEN psi > 0.25 THEN 'ALERT' WHEN psi > 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS band FROM glong JOIN psi USING (feature) GROUP BY feature, psi)\n"""


@R.add(_REPORT + "SELECT feature, round(psi, 6) AS psi, round(missing_shift, 6) AS missing_shift, band FROM report")
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    """DRF-04: drift of every feature."""
    return dr.drift_report(_glong(spark, folder)).select("feature", *r6("psi", "missing_shift"), "band")


@R.add(_REPORT + "SELECT count(*) FILTER (WHERE band = 'ALERT') AS n_alert, count(*) FILTER (WHERE band = 'MODERATE') AS n_moderate, CASE WHEN count(*) FILTER (WHERE band = 'ALERT') > 0 THEN 'ALERT' WHEN count(*) FILTER (WHERE band = 'MODERATE') > 2 THEN 'MODERATE' ELSE 'STABLE' END AS status FROM report")
def drift_status(spark: SparkSession, folder: str) -> DataFrame:
    """DRF-04: the load's status."""
    return dr.drift_status(dr.drift_report(_glong(spark, folder)))


@R.add(_GLONG + """
, w AS (SELECT feature, min(value) - 0.2 * CASE WHEN max(value) - min(value) <= 0 THEN 1 ELSE max(value) - min(value) END AS lo, max(value) + 0.2 * CASE WHEN max(value) - min(value) <= 0 THEN 1 ELSE max(value) - min(value) END AS hi FROM glong WHERE is_reference GROUP BY feature),
r AS (SELECT user_id, is_reference, avg((value IS NULL)::INT) AS missing, avg(coalesce(value < lo OR value > hi, false)::INT) AS violation_share FROM glong JOIN w USING (feature) GROUP BY ALL),
b AS (SELECT avg(missing) AS mu, stddev_pop(missing) + 1e-12 AS sd FROM r WHERE is_reference)
SELECT user_id, round((missing - mu) / sd, 5) AS missing_z, round(violation_share, 6) AS violation_share, CASE WHEN (missing - mu) / sd > 4 OR violation_share > 0.2 THEN 'OUT_OF_DISTRIBUTION' ELSE 'IN_DISTRIBUTION' END AS status FROM r, b""")
def ood_status(spark: SparkSession, folder: str) -> DataFrame:
    """OOD-01/02/04: rows with unusual gaps or values."""
    return dr.out_of_distribution(_glong(spark, folder), "user_id").select("user_id", F.round("missing_z", 5).alias("missing_z"), *r6("violation_share"), "status")


@R.add(_GLONG + """
, u AS (SELECT feature, value, count(*) FILTER (WHERE is_reference) AS a, count(*) FILTER (WHERE NOT is_reference) AS b FROM glong WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb FROM u WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature))
SELECT feature, round(max(abs(fa - fb)), 6) AS ks FROM c GROUP BY feature""")
def ks_shift(spark: SparkSession, folder: str) -> DataFrame:
    """SHD-06: largest gap of two distributions."""
    return pf.kolmogorov_smirnov(_glong(spark, folder), "is_reference").select("feature", *r6("ks"))


@R.add(_GLONG + """
SELECT feature, m BETWEEN p1 AND p99 AS is_inside FROM (SELECT feature, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM glong WHERE is_reference GROUP BY feature)
JOIN (SELECT feature, quantile_cont(value, 0.5) AS m FROM glong WHERE NOT is_reference GROUP BY feature) USING (feature)""")
def value_range_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """LAB-02: whether current medians lie in the reference's range."""
    return dr.range_coverage(_glong(spark, folder))


@R.add(GRID + """
, s AS (SELECT user_id, least(1, user_id / 100.0::DOUBLE) AS a, 0.5::DOUBLE + (user_id % 50) / 100.0::DOUBLE AS auc, (user_id % 11) / 10.0::DOUBLE AS m, (user_id % 7) / 6.0::DOUBLE AS v FROM grid),
t AS (SELECT user_id, 40 * a + 30 * least(greatest((1 - auc) / 0.5::DOUBLE, 0), 1) + 15 * m + 15 * v AS score FROM s)
SELECT user_id, round(score, 6) AS score, CASE WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'POOR' END AS band FROM t""")
def compat_score(spark: SparkSession, folder: str) -> DataFrame:
    """LAB-03/04: weighted compatibility and its band."""
    u = F.col("user_id")
    score = dr.compatibility(F.least(F.lit(1.0), u / 100.0), 0.5 + (u % 50) / 100.0, (u % 11) / 10.0, (u % 7) / 6.0)
    return grid(spark, folder).select("user_id", F.round(score, 6).alias("score"), dr.compatibility_band(score).alias("band"))


_KS = """
u AS (SELECT feature, value, count(*) FILTER (WHERE is_reference) AS a, count(*) FILTER (WHERE NOT is_reference) AS b FROM glong WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb FROM u WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)), ks AS (SELECT feature, max(abs(fa - fb)) AS ks FROM c GROUP BY feature)
"""


@R.add(_REPORT + "," + _KS + """, span AS (SELECT feature, quantile_cont(value, 0.01) FILTER (WHERE is_reference) AS p1, quantile_cont(value, 0.99) FILTER (WHERE is_reference) AS p99, quantile_cont(value, 0.5) FILTER (WHERE NOT is_reference) AS m FROM glong GROUP BY feature)
SELECT (SELECT round(max(psi), 6) FROM report) AS psi_max, (SELECT round(max(ks), 6) FROM ks) AS ks_max, (SELECT round(1 - avg(abs(missing_shift)), 6) FROM report) AS missing_consistency, (SELECT round(avg((m BETWEEN p1 AND p99)::INT), 6) FROM span) AS range_share,
  (SELECT CASE WHEN count(*) FILTER (WHERE band = 'ALERT') > 0 THEN 'ALERT' WHEN count(*) FILTER (WHERE band = 'MODERATE') > 2 THEN 'MODERATE' ELSE 'STABLE' END FROM report) AS status""")
def shield_report(spark: SparkSession, folder: str) -> DataFrame:
    """LAB-05: a load against the reference in one row: drift, gap of distributions, gaps, ranges, status."""
    long = cut_lineage(_glong(spark, folder))
    report = cut_lineage(dr.drift_report(long))  # one row a feature
    figures = report.agg(F.max("psi").alias("psi_max"), (1 - F.avg(F.abs("missing_shift"))).alias("missing_consistency"))
    ks = pf.kolmogorov_smirnov(long, "is_reference").agg(F.max("ks").alias("ks_max"))
    ranges = dr.range_coverage(long).agg(F.avg(F.col("is_inside").cast("double")).alias("range_share"))
    one = figures.crossJoin(ks).crossJoin(ranges).crossJoin(dr.drift_status(report).select("status"))  # one row each
    return one.select(*r6("psi_max", "ks_max", "missing_consistency", "range_share"), "status")


@R.add(_GLONG + """
, w AS (SELECT feature, min(value) - 0.2 * CASE WHEN max(value) - min(value) <= 0 THEN 1 ELSE max(value) - min(value) END AS lo, max(value) + 0.2 * CASE WHEN max(value) - min(value) <= 0 THEN 1 ELSE max(value) - min(value) END AS hi FROM glong WHERE is_reference GROUP BY feature),
r AS (SELECT user_id, is_reference, avg((value IS NULL)::INT) AS missing, avg(coalesce(value < lo OR value > hi, false)::INT) AS violation_share FROM glong JOIN w USING (feature) GROUP BY ALL),
b AS (SELECT avg(missing) AS mu, stddev_pop(missing) + 1e-12 AS sd FROM r WHERE is_reference)
SELECT user_id % 5 = 0 AS is_positive, count(*) AS n, count(*) FILTER (WHERE (missing - mu) / sd > 4) AS n_gaps, count(*) FILTER (WHERE violation_share > 0.2) AS n_ranges FROM r, b GROUP BY 1""")
def ood_lens(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-38: how many rows of each class the distribution checks mark, and by which ground."""
    seen = dr.out_of_distribution(_glong(spark, folder), "user_id")
    return seen.groupBy((F.col("user_id") % 5 == 0).alias("is_positive")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("missing_z") > dr.Z_LIMIT).alias("n_gaps"), F.count_if(F.col("violation_share") > dr.VIOLATION_SHARE).alias("n_ranges")
    )


@R.add(GRID + f", sided AS (SELECT user_id, held, user_id % 3 <> held AS is_reference, {', '.join(f'round({c}, 4) AS {c}' for c in _G)} FROM grid, range(3) h(held)), glong AS (SELECT held || '|' || feature AS feature, is_reference, value FROM (FROM sided UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_G)})))), " + _KS + """,
g AS (SELECT feature, avg((value IS NULL)::INT) FILTER (WHERE NOT is_reference) - avg((value IS NULL)::INT) FILTER (WHERE is_reference) AS shift FROM glong GROUP BY feature)
SELECT CAST(string_split(feature, '|')[1] AS INTEGER) AS held, round(max(ks), 6) AS ks_max, round(max(abs(shift)), 6) AS missing_shift FROM ks JOIN g USING (feature) GROUP BY 1""")
def fold_shift(spark: SparkSession, folder: str) -> DataFrame:
    """EXT-50: how each fold differs from the others: the largest gap of distributions and of missing shares."""
    g = grid(spark, folder).select("user_id", *(F.round(c, 4).alias(c) for c in _G))
    each = pf.long_form(g, _G, ["user_id"]).withColumn("held", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    sided = cut_lineage(each.select(F.concat_ws("|", F.col("held").cast("string"), "feature").alias("feature"), "value", (F.col("user_id") % 3 != F.col("held")).alias("is_reference")))
    empty = lambda side: F.avg(F.when(F.col("is_reference") == side, F.col("value").isNull().cast("double")))
    shift = sided.groupBy("feature").agg(F.abs(empty(False) - empty(True)).alias("shift"))
    both = pf.kolmogorov_smirnov(sided, "is_reference").join(shift, "feature")
    return both.groupBy(F.substring_index("feature", "|", 1).cast("int").alias("held")).agg(F.round(F.max("ks"), 6).alias("ks_max"), F.round(F.max("shift"), 6).alias("missing_shift"))
