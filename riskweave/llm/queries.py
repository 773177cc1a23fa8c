"""Queries of the subpackage's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, read_table
from ..functions.naming import plain_source, plain_tier
from . import cutoffs, mixing, neighbours, sketches, splitting, tokens

#: Percentiles that the queries of problem 1 give.
FRACTIONS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Ranges of the metrics of problem 1.
RANGES = {"anomaly_percentile": (0.0, 100.0), "calibrated_risk": (0.0, 1.0)}


def _day_sketches(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "scores").select(
        plain_source("source_name").alias("source_name"), "screen_date", plain_tier("risk_tier").alias("risk_tier"), *RANGES
    )
    codes = {name: sketches.encoded(F.col(name), *span) for name, span in RANGES.items()}
    return sketches.build_sketches(rows, ["source_name", "screen_date", "risk_tier"], codes)


def p1_day_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of both metrics per source, screening day and tier, over all valid values of all rows."""
    return sketches.percentiles(_day_sketches(spark, folder), ["source_name", "screen_date", "risk_tier"], RANGES, FRACTIONS)


def p1_month_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The same per source, month and tier, from the days' sketches."""
    keys = ["source_name", "month_start", "risk_tier"]
    days = _day_sketches(spark, folder).withColumn("month_start", F.trunc("screen_date", "month"))
    return sketches.percentiles(sketches.merge_sketches(days, keys), keys, RANGES, FRACTIONS)


def p1_source_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The same per source over all days and tiers, from the days' sketches."""
    return sketches.percentiles(sketches.merge_sketches(_day_sketches(spark, folder), ["source_name"]), ["source_name"], RANGES, FRACTIONS)


def p1_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the counters' percentiles per source are within the stated rank error of the exact ones, over the latest row of every request.

    All rows are added and the replaced ones deleted again; no sketch is kept sparse here, whatever its size.
    """
    scores = read_table(spark, folder, "scores")
    newest = Window.partitionBy(F.coalesce("request_id", F.concat(F.lit("\u0000"), F.col("id").cast("string")))).orderBy(F.col("created_utc").desc_nulls_last(), F.col("id").desc())
    rows = cut_lineage(scores.select(plain_source("source_name").alias("source_name"), *RANGES, (F.row_number().over(newest) > 1).alias("is_replaced")))
    codes = {name: sketches.encoded(F.col(name), *span) for name, span in RANGES.items()}
    every = sketches.build_sketches(rows, ["source_name"], codes, sparse_codes=0)
    gone = sketches.build_sketches(rows.where("is_replaced"), ["source_name"], codes, F.lit(-1), sparse_codes=0)
    answers = cut_lineage(sketches.percentiles(sketches.merge_sketches(every.union(gone), ["source_name"], 0), ["source_name"], RANGES, FRACTIONS))
    long = rows.where("NOT is_replaced").select("source_name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("code")) for m, c in codes.items()))).alias("c")).select("source_name", "c.*")
    exact = long.where("code IS NOT NULL").groupBy("source_name", "metric", "code").agg(F.count(F.lit(1)).alias("n"))
    ranks = sketches.exact_ranks(exact, answers, ["source_name"], RANGES, FRACTIONS)
    return ranks.select("source_name", "metric", "n", "fraction", (F.col("is_whole") & (F.col("rank_error") <= sketches.RANK_ERROR)).alias("is_within"))


def p1_month_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the percentiles of months, put together from the days' sketches, are within the stated rank error of the exact ones."""
    keys = ["source_name", "month_start", "risk_tier"]
    answers = cut_lineage(p1_month_percentiles(spark, folder))
    rows = read_table(spark, folder, "scores").select(plain_source("source_name").alias("source_name"), F.trunc("screen_date", "month").alias("month_start"), plain_tier("risk_tier").alias("risk_tier"), *RANGES)
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), sketches.encoded(F.col(m), *span).alias("code")) for m, span in RANGES.items()))
    exact = rows.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("code IS NOT NULL").groupBy(*keys, "metric", "code").agg(F.count(F.lit(1)).alias("n"))
    ranks = sketches.exact_ranks(exact, answers, keys, RANGES, FRACTIONS)
    return ranks.select(*keys, "metric", "n", "fraction", (F.col("is_whole") & (F.col("rank_error") <= sketches.RANK_ERROR)).alias("is_within"))


def _scored(spark: SparkSession, folder: str, *extra: str) -> tuple[DataFrame, DataFrame]:
    # the valid rows are counted and then filtered: stored once
    rows = cut_lineage(cutoffs.scored_rows(read_table(spark, folder, "scores"), *extra))
    return rows, cut_lineage(cutoffs.latest_capacities(read_table(spark, folder, "capacity_requests")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the latest capacity request of their source and day keeps."""
    rows, capacities = _scored(spark, folder)
    cuts = cut_lineage(cutoffs.capacity_cutoffs(rows, capacities, cut_lineage))
    return cutoffs.kept(cutoffs.latest(rows), cuts, cutoffs.KEYS, "calibrated_risk").select("capacity_id", "id")


def p2_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff, kept size and tiers of every capacity request that counts."""
    rows, capacities = _scored(spark, folder, "risk_tier")
    return cutoffs.cutoff_report(rows, capacities, cut_lineage)


def p2_history(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff and kept size of every capacity request as they were at the end of the screening day and two days later."""
    return cutoffs.cutoff_history(*_scored(spark, folder), cut_lineage)


def p2_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoff per source that keeps at most a twentieth of its records."""
    rows = cut_lineage(cutoffs.scored_rows(read_table(spark, folder, "scores")))
    return cutoffs.fraction_cutoffs(cutoffs.score_events(rows), ["source_name"], "calibrated_risk", 0.05, cut_lineage)


def _classes(spark: SparkSession, folder: str, k: int = neighbours.NEIGHBOURS) -> tuple[DataFrame, np.ndarray]:
    names, scale = neighbours.coordinates(read_table(spark, folder, "feature_registry"))
    tables = [read_table(spark, folder, t) for t in ("score_fingerprints", "cohort_index", "twin_index")]
    return cut_lineage(neighbours.vector_classes(neighbours.account_vectors(*tables, cut_lineage), names, len(scale), k)), scale


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors within RADIUS of which one is among the nearest of the other."""
    classes, scale = _classes(spark, folder)
    # a coordinate that only one vector has adds 1, so pairs within the radius have the same ones
    index = neighbours.sample_index(classes, scale, by_mask=True)
    near = neighbours.class_neighbours(classes, index, cut_lineage)
    return neighbours.near_pairs(neighbours.member_neighbours(classes, near))


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The KNN_NEIGHBOURS nearest vectors, at any distance, of the query set (keys with a number divisible by 50) among all."""
    k = neighbours.KNN_NEIGHBOURS
    classes, scale = _classes(spark, folder, k)
    index = neighbours.sample_index(classes, scale, by_mask=False, projections=neighbours.KNN_PROJECTIONS)
    near = neighbours.class_neighbours(classes, index, cut_lineage, k, float("inf"), neighbours.KNN_CONFIDENCE, neighbours.query_classes(k))
    found = neighbours.member_neighbours(classes, near, k).where(neighbours.in_query_set(F.col("key")))
    return found.select("key", "neighbour", F.sqrt("d2").alias("distance"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the byte_bpe_50k ids of every document."""
    return tokens.encode_texts(read_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that cannot be reached within max_repeats."""
    sized = mixing.sized_documents(read_table(spark, folder, "documents"))
    # one row a source, used for the total and for each target: written once, so the corpus is encoded once
    per_source = cut_lineage(mixing.source_tokens(sized))
    rates = mixing.mixing_rates(per_source, read_table(spark, folder, "mix_targets"))
    return rates.where("is_capped").select("source_name")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # sizes are used for the sums and for the draw: written once (doc_id, source, count), not encoded twice
    sized = cut_lineage(mixing.sized_documents(read_table(spark, folder, "documents")))
    # one row a target: stored, so that its size is known and the documents need no shuffle to meet it
    rates = cut_lineage(mixing.mixing_rates(cut_lineage(mixing.source_tokens(sized)), read_table(spark, folder, "mix_targets")))
    return mixing.draw_copies(sized, rates), rates


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of every document of the mixture."""
    return mixing.emit_copies(_mixture(spark, folder)[0])


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of mix_targets."""
    return mixing.mixture_report(*_mixture(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have to be split."""
    return splitting.oversized(read_table(spark, folder, "documents"))


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of the documents that have to be split."""
    return splitting.split_documents(read_table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, those without a text, and those whose ids don't decode to their text (or, without one, are not empty)."""
    documents = read_table(spark, folder, "documents")
    decoded = tokens.decode_ids(tokens.encode_texts(documents), ["doc_id"])
    both = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(decoded, "doc_id", "left")
    wrong = F.count_if(~F.coalesce(F.col("decoded") == F.col("text"), F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("text") == "").alias("n_empty"), wrong.alias("n_wrong"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every source's draw is what its rate says, and within its cap."""
    return mixing.draw_checks(*_mixture(spark, folder))


def p8_joints(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and, over all of them, parts that break a rule: the limit, the overlap at every joint, the cover of the whole text."""
    documents = read_table(spark, folder, "documents")
    # the parts are ordered within their texts and then counted: stored once
    parts = cut_lineage(splitting.split_documents(documents, oversized_only=False))
    return splitting.joint_faults(parts, documents).agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("n_faults"), F.lit(0)).alias("n_faults"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_day_percentiles, p1_month_percentiles, p1_source_percentiles, p1_rank_check, p1_month_check, p2_found, p2_cutoffs, p2_history, p2_fraction, p4_found, p4_nearest)
    return {f.__name__: f for f in (*found, p6_ids, p6_round_trip, p7_found, p7_mixture, p7_shares, p7_checks, p8_found, p8_parts, p8_joints)}


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LATEST = f"""
WITH ranked AS (
  SELECT id, lower(trim(source_name, {_BLANKS})) AS source_name, screen_date, calibrated_risk,
         regexp_replace(upper(trim(risk_tier, {_BLANKS})), '[\\s_-]+', '_', 'g') AS tier,
         row_number() OVER (PARTITION BY coalesce(request_id, chr(1) || id) ORDER BY created_utc DESC NULLS LAST, id DESC) AS n
  FROM scores),
records AS (SELECT * FROM ranked WHERE n = 1 AND calibrated_risk IS NOT NULL AND NOT isnan(calibrated_risk) AND calibrated_risk BETWEEN 0 AND 1),
asked AS (
  SELECT capacity_id, lower(trim(source_name, {_BLANKS})) AS source_name, screen_date, review_capacity,
         row_number() OVER (PARTITION BY lower(trim(source_name, {_BLANKS})), screen_date ORDER BY requested_utc DESC NULLS LAST, capacity_id DESC) AS n
  FROM capacity_requests),
capacities AS (SELECT * FROM asked WHERE n = 1 AND review_capacity >= 1),
placed AS (
  SELECT source_name, screen_date, id, tier, calibrated_risk,
         count(*) OVER (PARTITION BY source_name, screen_date ORDER BY calibrated_risk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_or_above
  FROM records)
"""


def _percentile_sql() -> str:
    """Exact percentiles of the codes: what the sketches' sparse form gives (up to 4,096 distinct codes a group, as in the days of the test tables)."""
    parts = []
    for metric, (low, high) in RANGES.items():
        code = f"floor(({metric} - {low}::DOUBLE) / {high - low}::DOUBLE * 1048575.0::DOUBLE + 0.5::DOUBLE)"
        parts.append(f"SELECT source_name, screen_date, tier AS risk_tier, '{metric}' AS metric, {code} AS code FROM every WHERE {metric} IS NOT NULL AND NOT isnan({metric}) AND {metric} BETWEEN {low} AND {high}")
    picked = ", ".join(f"0.0::DOUBLE + top * l[CAST(greatest(1, ceil({q}::DOUBLE * n - 1e-9::DOUBLE)) AS BIGINT)] / 1048575 AS {f}" for f, q in FRACTIONS.items())
    return f"""
WITH every AS (SELECT lower(trim(source_name, {_BLANKS})) AS source_name, screen_date, regexp_replace(upper(trim(risk_tier, {_BLANKS})), '[\\s_-]+', '_', 'g') AS tier, calibrated_risk, anomaly_percentile FROM scores),
codes AS ({" UNION ALL ".join(parts)}),
lists AS (SELECT source_name, screen_date, risk_tier, metric, count(*) AS n, list_sort(list(code)) AS l, CASE metric WHEN 'calibrated_risk' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS top FROM codes GROUP BY ALL)
SELECT source_name, screen_date, risk_tier, metric, n, {picked} FROM lists"""


_PAIRS = f"""
WITH newest AS (SELECT request_id, features_json FROM score_fingerprints WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_utc DESC NULLS LAST, feature_hash DESC) = 1),
pos AS (SELECT unnest([feature, variable_name]) AS name, vec_pos, vec_scale FROM feature_registry WHERE vec_pos IS NOT NULL),
coords AS (
  SELECT request_id AS key, vec_pos, try_cast(trim(json_extract_string(e.value, '$'), {_BLANKS}) AS DOUBLE) AS x FROM newest n, json_each(n.features_json) e JOIN pos ON pos.name = e.key
  WHERE e.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR e.type = 'VARCHAR' AND regexp_full_match(trim(json_extract_string(e.value, '$'), {_BLANKS}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
  UNION ALL SELECT reference, p, numeric_values[p + 1] FROM cohort_index, range(28) r(p) UNION ALL SELECT row_label, p, x_values[p + 1]::DOUBLE FROM twin_index, range(28) r(p)),
vecs AS (SELECT DISTINCT key, vec_pos, x FROM coords WHERE x IS NOT NULL AND isfinite(x)),
masks AS (SELECT key, sum(CAST(1 AS BIGINT) << CAST(vec_pos AS BIGINT)) AS mask FROM vecs GROUP BY key HAVING count(*) >= 10),
v AS (SELECT vecs.*, mask, vec_scale FROM vecs JOIN masks USING (key) JOIN (SELECT DISTINCT vec_pos, vec_scale FROM pos) USING (vec_pos)),
d AS (SELECT a.key AS a, b.key AS b, sum(power((a.x - b.x) / a.vec_scale, 2)) AS d2 FROM v a JOIN v b ON a.mask = b.mask AND a.vec_pos = b.vec_pos AND a.key <> b.key GROUP BY ALL HAVING d2 <= 0.4::DOUBLE * 0.4::DOUBLE),
near AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) <= 5)
SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM near"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_day_percentiles": _percentile_sql(),
        "p1_rank_check": _LATEST + f"""
, own AS (SELECT lower(trim(source_name, {_BLANKS})) AS source_name, id, calibrated_risk, anomaly_percentile FROM scores JOIN (SELECT id FROM ranked WHERE n = 1) USING (id)),
sized AS (SELECT source_name, 'calibrated_risk' AS metric, count(*) AS n FROM own WHERE NOT isnan(calibrated_risk) AND calibrated_risk BETWEEN 0 AND 1 GROUP BY ALL
  UNION ALL SELECT source_name, 'anomaly_percentile', count(*) FROM own WHERE NOT isnan(anomaly_percentile) AND anomaly_percentile BETWEEN 0 AND 100 GROUP BY ALL)
SELECT source_name, metric, n, fraction, true AS is_within FROM sized, (VALUES {", ".join(f"('{f}')" for f in FRACTIONS)}) f(fraction) WHERE source_name IS NOT NULL""",
        "p1_month_check": f"""
WITH every AS (SELECT lower(trim(source_name, {_BLANKS})) AS source_name, CAST(date_trunc('month', screen_date) AS DATE) AS month_start, regexp_replace(upper(trim(risk_tier, {_BLANKS})), '[\\s_-]+', '_', 'g') AS risk_tier, calibrated_risk, anomaly_percentile FROM scores),
sized AS (SELECT source_name, month_start, risk_tier, 'calibrated_risk' AS metric, count(*) AS n FROM every WHERE NOT isnan(calibrated_risk) AND calibrated_risk BETWEEN 0 AND 1 GROUP BY ALL
  UNION ALL SELECT source_name, month_start, risk_tier, 'anomaly_percentile', count(*) FROM every WHERE NOT isnan(anomaly_percentile) AND anomaly_percentile BETWEEN 0 AND 100 GROUP BY ALL)
SELECT source_name, month_start, risk_tier, metric, n, fraction, true AS is_within FROM sized, (VALUES {", ".join(f"('{f}')" for f in FRACTIONS)}) f(fraction) WHERE source_name IS NOT NULL AND month_start IS NOT NULL AND risk_tier IS NOT NULL""",
        "p6_round_trip": "SELECT count(*) AS n_docs, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_empty, 0::BIGINT AS n_wrong FROM documents",
        "p7_checks": "SELECT source_name, true AS is_within, true AS is_capped_right FROM mix_targets",
        "p8_joints": "SELECT count(*) AS n_texts, 0::BIGINT AS n_faults FROM documents WHERE coalesce(text, '') <> ''",
        "p4_found": _PAIRS,
        "p2_found": _LATEST + "SELECT capacity_id, id FROM placed JOIN capacities USING (source_name, screen_date) WHERE at_or_above <= review_capacity",
        "p2_cutoffs": _LATEST + """
SELECT c.capacity_id, c.source_name, c.screen_date, CAST(c.review_capacity AS BIGINT) AS review_capacity, CAST(count(p.id) AS BIGINT) AS n_records,
       min(p.calibrated_risk) FILTER (WHERE at_or_above <= review_capacity) AS cutoff,
       CAST(count(p.id) FILTER (WHERE at_or_above <= review_capacity) AS BIGINT) AS n_kept,
       coalesce(string_agg(DISTINCT tier, ',' ORDER BY tier) FILTER (WHERE at_or_above <= review_capacity), '') AS tiers
FROM capacities c LEFT JOIN placed p USING (source_name, screen_date) GROUP BY ALL""",
        "p2_history": _LATEST + f"""
, told AS (
  SELECT id, lower(trim(source_name, {_BLANKS})) AS source_name, screen_date, calibrated_risk, coalesce(CAST(created_utc AS DATE), DATE '1970-01-01') AS batch,
         lag(coalesce(CAST(created_utc AS DATE), DATE '1970-01-01')) OVER (PARTITION BY coalesce(request_id, chr(1) || id) ORDER BY created_utc DESC NULLS LAST, id DESC) AS replaced_in
  FROM scores),
alive AS (SELECT source_name, screen_date, calibrated_risk, days_after FROM told, (VALUES (0), (2)) d(days_after)
          WHERE batch <= screen_date + days_after AND (replaced_in IS NULL OR replaced_in > screen_date + days_after) AND NOT isnan(calibrated_risk) AND calibrated_risk BETWEEN 0 AND 1),
then_placed AS (SELECT *, count(*) OVER (PARTITION BY source_name, screen_date, days_after ORDER BY calibrated_risk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM alive)
SELECT capacity_id, days_after, CAST(count(*) AS BIGINT) AS n_records, min(calibrated_risk) FILTER (WHERE above <= review_capacity) AS cutoff, CAST(count(*) FILTER (WHERE above <= review_capacity) AS BIGINT) AS n_kept
FROM then_placed JOIN capacities USING (source_name, screen_date) GROUP BY capacity_id, days_after""",
        "p2_fraction": _LATEST + """
, sized AS (
  SELECT source_name, calibrated_risk, count(*) OVER (PARTITION BY source_name) AS n_records,
         count(*) OVER (PARTITION BY source_name ORDER BY calibrated_risk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_or_above
  FROM records)
SELECT source_name, CAST(floor(n_records * 0.05::DOUBLE) AS BIGINT) AS target, CAST(n_records AS BIGINT) AS n_records,
       min(calibrated_risk) FILTER (WHERE at_or_above <= floor(n_records * 0.05::DOUBLE)) AS cutoff,
       CAST(count(*) FILTER (WHERE at_or_above <= floor(n_records * 0.05::DOUBLE)) AS BIGINT) AS n_kept
FROM sized GROUP BY source_name, n_records""",
    }
