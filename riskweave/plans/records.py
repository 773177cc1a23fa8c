"""Queries on dirty text, headers, exports and stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as can
from ..operators import store
from ..session import read_table
from .fixtures import DIRTY, GRID, OOF, dirty, grid, oof
from .registry import Registry

R = Registry()

_CLEAN = DIRTY + ", clean AS (SELECT *, nullif(trim(num_txt), 'NA') AS n, nullif(trim(cat_txt), 'NA') AS c FROM dirty)\n"


@R.add(_CLEAN + "SELECT row_index, n::DOUBLE AS num_txt, c AS cat_txt, true_date AS date_txt FROM clean")
def canonicalise(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-01, SRC-05, REL-24: text columns by what they hold."""
    return can.canonicalise(dirty(spark, folder), dates=("date_txt",))


@R.add(_CLEAN + """SELECT 'num_txt' AS "column", count(*) FILTER (WHERE trim(num_txt) = 'NA') AS n_na, count(n) AS n_values, count(*) FILTER (WHERE n IS NOT NULL AND try_cast(n AS DOUBLE) IS NULL) AS n_unparsed, 'number' AS kind FROM clean
UNION ALL SELECT 'cat_txt', 0, count(c), count(*) FILTER (WHERE try_cast(c AS DOUBLE) IS NULL), 'category' FROM clean UNION ALL SELECT 'date_txt', 0, count(*), 0, 'date' FROM clean""")
def canonicalise_report(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-01: what each text column was found to be."""
    return can.column_report(dirty(spark, folder), dates=("date_txt",))


@R.add(_CLEAN + "SELECT row_index::DOUBLE AS row_index, n::DOUBLE AS num_txt, try_cast(c AS DOUBLE) AS cat_txt, true_date AS date_txt, NULL::VARCHAR AS absent FROM clean")
def coerce_request(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-02: a request coerced to a stated schema."""
    return can.coerce(dirty(spark, folder), {"row_index": "number", "num_txt": "number", "cat_txt": "number", "date_txt": "date", "absent": "category"})


@R.add(_CLEAN + """, levels AS (SELECT c, (row_number() OVER (ORDER BY c) - 1)::DOUBLE AS code FROM (SELECT DISTINCT c FROM clean WHERE row_index % 2 = 0 AND c IS NOT NULL))
SELECT row_index, clean.c AS cat_txt, CASE WHEN clean.c IS NOT NULL THEN coalesce(code, -1) END AS cat_txt_code FROM clean LEFT JOIN levels ON clean.c = levels.c""")
def ordinal_encode(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-03, SIM-02: codes of the sorted levels of one part, applied to all rows."""
    df = dirty(spark, folder).select("row_index", can.cleaned("cat_txt").alias("cat_txt"))
    return can.ordinal_encode(df, can.ordinal_levels(df.where("row_index % 2 = 0"), "cat_txt"), "cat_txt").select("row_index", "cat_txt", "cat_txt_code")


_HEADERS = ["F0103", "tot_txnamt_cr_l7d", " F0118 ", "TOT-TXNAMT-DB-L31D", "nothing", "Upi.Amt.Cr.L7D", "F0204", "atm amt db l7d"]


@R.add(f"""
WITH h AS (SELECT unnest({_HEADERS}) AS header), hk AS (SELECT header, regexp_replace(upper(header), '[^A-Z0-9]+', '', 'g') AS k FROM h),
a AS (SELECT DISTINCT regexp_replace(upper(n), '[^A-Z0-9]+', '', 'g') AS k, feature FROM (SELECT feature, unnest([feature, variable_name]) AS n FROM feature_registry)), i AS (SELECT k, count(*) AS n, min(feature) AS target FROM a GROUP BY k),
j AS (SELECT header, n, target, count(*) FILTER (WHERE n = 1) OVER (PARTITION BY coalesce(target, header)) AS taken FROM hk LEFT JOIN i USING (k))
SELECT header, CASE WHEN n = 1 AND taken = 1 THEN target END AS feature, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n > 1 THEN 'AMBIGUOUS' WHEN taken > 1 THEN 'COLLISION' ELSE 'MAPPED' END AS status FROM j""")
def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-05..08: headers to features, ambiguous and colliding ones refused."""
    headers = spark.createDataFrame([(h,) for h in _HEADERS], "header string")
    return can.resolve_headers(headers, read_table(spark, folder, "feature_registry").select("feature", "variable_name"))


@R.add(DIRTY + """SELECT 'needed' AS missing, 'date_txt' AS extra, 0 AS n_all_null, 0 AS n_unreadable, CAST(0 AS BIGINT) AS n_repeated, 'FAIL' AS status""")
def schema_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """LAB-01, REL-13/14: a load against the columns it should have."""
    out = can.schema_integrity(dirty(spark, folder), ["row_index", "num_txt", "cat_txt", "needed"], ["num_txt", "cat_txt"])
    return out.withColumn("n_repeated", F.col("n_repeated").cast("bigint"))


@R.add("SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS safe FROM (SELECT o_orderkey, ['=', '+', '-', '@', 'a', ' ='][o_orderkey % 6 + 1] || o_orderpriority AS t FROM orders)")
def csv_safe(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-29, REL-25: text that a spreadsheet takes as text."""
    sign = F.element_at(F.array(*(F.lit(x) for x in ("=", "+", "-", "@", "a", " ="))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read_table(spark, folder, "orders").select("o_orderkey", can.csv_safe(F.concat(sign, "o_orderpriority")).alias("safe"))


@R.add(OOF + "SELECT row_index AS id, (score >= 0.5)::INT AS prediction FROM oof WHERE model = 'm_a' AND rep = 0")
def submission_minimal(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-11/12, EXT-69: two-column export at a threshold."""
    return can.submission(oof(spark, folder).where("model = 'm_a' AND rep = 0"), "row_index", "score", 0.5)


@R.add(OOF + "SELECT count(*) - (SELECT count(*) FROM orders) AS n_size_off, count(*) FILTER (WHERE row_index IS NULL OR score IS NULL) AS n_null, count(row_index) - count(DISTINCT row_index) AS n_repeated_ids, count(*) FILTER (WHERE NOT score BETWEEN 0 AND 1) AS n_out_of_range FROM oof WHERE model = 'm_a' AND rep = 0")
def submission_checks(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-15: violations of an export."""
    rows = can.submission(oof(spark, folder).where("model = 'm_a' AND rep = 0"), "row_index", "score")
    return can.submission_checks(rows, read_table(spark, folder, "orders").count())


@R.add("SELECT 'a' AS \"column\", true AS is_index UNION ALL SELECT 'b', true UNION ALL SELECT 'o_custkey', false UNION ALL SELECT 'row_id', true")
def index_columns(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-09: columns that only number the rows."""
    df = read_table(spark, folder, "orders").select((F.col("o_orderkey") * 1).alias("place"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), "o_custkey", F.col("o_custkey").alias("row_id"))
    return can.index_columns(df, "place", ["a", "b", "o_custkey", "row_id"])


@R.add("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, CAST(sum((o_orderkey % 97 = 0)::INT) AS BIGINT) AS n_pos, round(avg((o_orderkey % 97 = 0)::INT), 6) AS prevalence FROM orders")
def dataset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-25, MET-11: size and label distribution."""
    pos = (F.col("o_orderkey") % 97 == 0).cast("int")
    return read_table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.sum(pos).alias("n_pos"), F.round(F.avg(pos), 6).alias("prevalence"))


@R.add("SELECT true AS same_in_any_order, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n_rows")
def frame_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-22/23, EXT-57/65, LAB-07: a digest that doesn't depend on row order or partitions."""
    df = read_table(spark, folder, "orders")
    a, b = can.content_digest(df, df.columns), can.content_digest(df.repartition(7, "o_custkey"), df.columns).toDF("m", "d2", "c2")
    return a.crossJoin(b).select(((F.col("digest") == F.col("d2")) & (F.col("check") == F.col("c2"))).alias("same_in_any_order"), "n_rows")  # one row each


@R.add("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || CASE WHEN c_nationkey % 5 <> 0 THEN ',"c_nationkey":' || c_nationkey ELSE '' END || '}') AS digest FROM customer""")
def feature_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-17: the digest of each row's features as JSON, keys in order, nulls left out."""
    rows = read_table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return rows.select("c_custkey", store.fingerprint(["c_nationkey", "c_custkey"]).alias("digest"))


@R.add("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """SV-08, REL-28: the last row of each key."""
    return store.latest(read_table(spark, folder, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type", "value")


@R.add(OOF + "SELECT row_index, score FROM oof WHERE model = 'm_a' AND rep = 0 AND score >= 0.3 ORDER BY score DESC, row_index LIMIT 500")
def case_queue(spark: SparkSession, folder: str) -> DataFrame:
    """SV-01, REL-17/27, UI-02: the cases with the highest risk."""
    return store.queue(oof(spark, folder).where("model = 'm_a' AND rep = 0 AND score >= 0.3").select("row_index", "score"), "score", "row_index")


_SNAP = OOF + """
, s AS (SELECT rep, row_index, score, CASE WHEN score >= 0.6 THEN 'HIGH' ELSE 'LOW' END AS tier FROM oof WHERE model = 'm_a'), a AS (SELECT * FROM s WHERE rep = 0 AND row_index % 101 <> 0), b AS (SELECT * FROM s WHERE rep = 1 AND row_index % 103 <> 0)
"""


@R.add(_SNAP + """
SELECT count(*) FILTER (WHERE b.row_index IS NULL) AS n_lost, count(*) FILTER (WHERE a.row_index IS NULL) AS n_new, max(abs(a.score - b.score)) AS max_difference, count(*) FILTER (WHERE abs(a.score - b.score) > 1e-12) AS n_moved,
       count(*) FILTER (WHERE a.tier <> b.tier) AS n_tier_changed, 'FAIL' AS verdict FROM a FULL JOIN b ON a.row_index = b.row_index""")
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """SV-10, SRC-26: what differs between two snapshots."""
    rows = oof(spark, folder).where("model = 'm_a'").withColumn("tier", F.when(F.col("score") >= 0.6, "HIGH").otherwise("LOW"))
    return store.snapshot_diff(rows.where("rep = 0 AND row_index % 101 <> 0"), rows.where("rep = 1 AND row_index % 103 <> 0"), "row_index", "score", "tier")


@R.add("SELECT event_id, regexp_matches(p, '(?:^|[^A-Za-z0-9_])(?:F3912|F3924)(?:$|[^A-Za-z0-9_])') AS is_forbidden FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"F3912\": 1}' WHEN 1 THEN '{\"xF3912\": 1}' WHEN 2 THEN 'reads F3924' ELSE 'F39240' END AS p FROM events)")
def forbidden_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """FW-10/13, REL-30, EX-12: payloads that name a quarantined column."""
    m = F.col("event_id") % 4
    p = F.when(m == 0, '{"F3912": 1}').when(m == 1, '{"xF3912": 1}').when(m == 2, "reads F3924").otherwise("F39240")
    return read_table(spark, folder, "events").select("event_id", store.names_forbidden(p, ["F3912", "F3924"]).alias("is_forbidden"))


_CASE = OOF + """
, c AS (SELECT row_index, score AS risk, CASE WHEN score >= 0.6 THEN 'CRITICAL_REVIEW' WHEN score >= 0.3 THEN 'STANDARD_REVIEW' ELSE 'MONITOR' END AS tier, CASE WHEN row_index % 3 = 0 THEN 'MODEL_DISAGREEMENT' ELSE 'MODEL_CONSENSUS' END AS status,
   (row_index % 7) / 10.0::DOUBLE AS w1, row_index % 2 = 0 AS r1, (row_index % 5) / 10.0::DOUBLE AS w2, row_index % 5 <> 0 AS r2, (row_index % 100) / 100.0::DOUBLE AS agreement, row_index % 11 = 0 AS ood FROM oof),
w AS (SELECT *, r1::INT * w1 + r2::INT * w2 AS pro, (1 - r1::INT) * w1 + (1 - r2::INT) * w2 + CASE WHEN agreement < 0.85 THEN 1 - agreement ELSE 0 END + CASE WHEN ood THEN 0.6::DOUBLE ELSE 0 END AS con, agreement < 0.85 OR ood AS doubted FROM c),
b AS (SELECT *, coalesce(pro / nullif(pro + con, 0), 0) AS balance, status = 'MODEL_DISAGREEMENT' OR doubted AS contested FROM w)
"""


@R.add(_CASE + """
SELECT verdict, contested, count(*) AS n, round(avg(balance), 6) AS mean_balance FROM (SELECT *, CASE WHEN (tier = 'MONITOR' OR risk < 0.2) AND risk >= 0.05 THEN 'MONITOR' WHEN tier = 'MONITOR' OR risk < 0.2 THEN 'NO_ACTION' WHEN pro = 0 THEN 'INSUFFICIENT_EVIDENCE'
  WHEN balance >= 0.65 AND NOT contested THEN 'ENHANCED_REVIEW' WHEN balance >= 0.5 THEN 'REVIEW' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM b) GROUP BY ALL""")
def evidence_balance(spark: SparkSession, folder: str) -> DataFrame:
    """EX-05..09: evidence for and against, with the doubts of the score itself."""
    i = F.col("row_index")
    reason = lambda n, raises: F.struct(((i % n) / 10.0).alias("weight"), raises.alias("raises"))
    rows = oof(spark, folder).select(
        "row_index", F.col("score").alias("risk"), F.when(F.col("score") >= 0.6, "CRITICAL_REVIEW").when(F.col("score") >= 0.3, "STANDARD_REVIEW").otherwise("MONITOR").alias("tier"),
        F.when(i % 3 == 0, "MODEL_DISAGREEMENT").otherwise("MODEL_CONSENSUS").alias("status"), F.array(reason(7, i % 2 == 0), reason(5, i % 5 != 0)).alias("reasons"),
        store.doubts((i % 100) / 100.0, F.lit("HIGH_RISK_SET"), F.when(i % 11 == 0, "OUT_OF_DISTRIBUTION").otherwise("IN_DISTRIBUTION"), F.lit(99.0), F.lit(True)).alias("doubts"),
    )
    return store.evidence_balance(rows, "row_index").groupBy("verdict", "contested").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 6).alias("mean_balance"))


@R.add(GRID + """
, u AS (FROM grid UNPIVOT (value FOR feature IN (TOT_TXNAMT_DB_L7D, TOT_TXNAMT_CR_L7D, UPI_AMT_CR_L7D, ATM_AMT_DB_L7D))),
t AS (SELECT user_id, feature, round(value - 500, 4) AS value, row_number() OVER (PARTITION BY user_id ORDER BY abs(round(value - 500, 4)) DESC, feature) AS place FROM u)
SELECT user_id, CAST(place - 1 AS INTEGER) AS place, feature, value FROM t WHERE place <= 2""")
def top_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """EA-04, SIM-11/25: the largest contributions of a row, nested and flat again."""
    names = ("TOT_TXNAMT_DB_L7D", "TOT_TXNAMT_CR_L7D", "UPI_AMT_CR_L7D", "ATM_AMT_DB_L7D")
    parts = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), F.round(F.col(c) - 500, 4).alias("value"))) for c in names)))
    return grid(spark, folder).select("user_id", F.posexplode(store.top_contributions(parts, 2)).alias("place", "c")).select("user_id", "place", "c.feature", "c.value")


@R.add("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_join_chain(spark: SparkSession, folder: str) -> DataFrame:
    """REL-03/08/09: a chain of joins under a rollup."""
    c, n, r = (read_table(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@R.add("SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 50 EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """REL-05/06/12: intersection and difference of key sets."""
    e = read_table(spark, folder, "events")
    of = lambda kind, least: e.where((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id")
    return of("purchase", 50).intersect(of("error", 50)).subtract(of("signup", 200))
