"""Queries of the general training-data operators (problems 3 and 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.schema_drift import SchemaDrift
from ..session import cut_lineage, read_table
from ..sources.feature_files import file_sequence, load_registry


def _drift(spark: SparkSession, folder: str) -> SchemaDrift:
    return SchemaDrift(read_table(spark, folder, "score_requests"), load_registry(read_table(spark, folder, "feature_registry")), cut_lineage)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of fields from file to file, and the dry runs that miscounted."""
    return _drift(spark, folder).changes(read_table(spark, folder, "organiser_dry_run"))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All counted lines under one schema."""
    return _drift(spark, folder).table()


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The values of p3_table in long form: one row a line and feature that has a value."""
    table = p3_table(spark, folder)
    kinds = [(f.name, f.dataType.simpleString()) for f in table.schema if f.name not in ("file_id", "line_no", "account_reference", "other")]
    cell = [F.struct(F.lit(c).alias("column_name"), (F.col(c) if k == "double" else F.lit(None).cast("double")).alias("number"), (F.col(c) if k == "string" else F.lit(None).cast("string")).alias("words")) for c, k in kinds]
    return table.select("file_id", "line_no", F.explode(F.array(*cell)).alias("c")).select("file_id", "line_no", "c.*").where("number IS NOT NULL OR words IS NOT NULL")


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    registry = load_registry(read_table(spark, folder, "feature_registry"))
    return quality.file_profile(read_table(spark, folder, "score_requests"), registry, cut_lineage)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every issue of a file's columns and of the dry runs' figures."""
    registry = load_registry(read_table(spark, folder, "feature_registry"))
    runs = quality.dry_run_issues(read_table(spark, folder, "organiser_dry_run"), registry)
    return quality.column_issues(_profile(spark, folder)).union(runs)


def p5_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of a file's column that is outside its limits, with both."""
    return quality.limit_violations(_profile(spark, folder)).select("file_id", "column_name", "issue", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


def _rounded(profile: DataFrame) -> DataFrame:
    digits = {c: 9 for c in ("missing_share", "prev_missing_share")} | {f"{p}{c}": 6 for c in ("low", "p10", "p50", "p90", "high") for p in ("", "prev_")}
    return profile.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in profile.columns))


def p5_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every registry feature of every file, beside its source's previous file."""
    return _rounded(_profile(spark, folder))


def p5_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same profile from the stored states of two loads, each of which has half of the lines of every file."""
    registry = load_registry(read_table(spark, folder, "feature_registry"))
    lines = read_table(spark, folder, "score_requests")
    first = quality.load_states(lines.where("coalesce(line_no, 0) % 2 = 0"), registry, cut_lineage)
    second = quality.load_states(lines.where("coalesce(line_no, 0) % 2 <> 0"), registry, cut_lineage)
    merged = quality.metrics_of(first.unionByName(second), registry, cut_lineage)
    return _rounded(quality.profile_of(merged, cut_lineage(file_sequence(lines)), registry))


def p5_control(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics outside the control limits of their source's history."""
    return quality.control_limits(_profile(spark, folder)).select("file_id", "column_name", "metric", *(F.round(c, 6).alias(c) for c in ("value", "mean", "sd")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_table, p3_cells, p5_found, p5_limits, p5_profile, p5_incremental, p5_control)}


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Lines, fields and values as the statements of problems 3 and 5 define them.
_VALUES = f"""
WITH firsts AS (SELECT * FROM score_requests WHERE file_id IS NOT NULL QUALIFY line_no IS NULL OR row_number() OVER (PARTITION BY file_id, line_no ORDER BY line_id) = 1),
lines AS (SELECT file_id, line_id, line_no, account_reference, features FROM firsts WHERE CASE WHEN json_valid(features) THEN json_type(features) = 'OBJECT' ELSE false END),
sizes AS (SELECT file_id, count(*) AS n_lines FROM lines GROUP BY file_id),
files AS (SELECT file_id, lag(file_id) OVER (PARTITION BY min(source_name) ORDER BY min(file_seq), file_id) AS prev_id FROM score_requests WHERE file_id IS NOT NULL GROUP BY file_id),
named AS (SELECT DISTINCT regexp_replace(upper(n), '[^A-Z0-9]+', '', 'g') AS plain, feature FROM (SELECT feature, unnest([feature, variable_name]) AS n FROM feature_registry)),
each_value AS (SELECT l.file_id, l.line_id, l.line_no, l.account_reference, e.key AS field, e.type AS t, json_extract_string(e.value, '$') AS s FROM lines l, json_each(l.features) e),
kv AS (SELECT v.*, regexp_replace(upper(field), '[^A-Z0-9]+', '', 'g') AS plain, trim(s, {_BLANKS}) AS words, t = 'NULL' OR t = 'VARCHAR' AND upper(trim(s, {_BLANKS})) IN ('', 'NA', 'N/A', 'NULL') AS missing,
         CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' END AS kind,
         CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') OR t = 'VARCHAR' AND regexp_full_match(trim(s, {_BLANKS}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(s, {_BLANKS}) AS DOUBLE) END AS num FROM each_value v)
"""
_RENAMES = _VALUES + """
, fields AS (SELECT file_id, field, any_value(plain) AS plain, count(*) FILTER (WHERE NOT missing AND kind = 'number') AS a, count(*) FILTER (WHERE NOT missing AND kind = 'string') AS b, count(*) FILTER (WHERE NOT missing AND kind = 'boolean') AS c FROM kv GROUP BY file_id, field),
typed AS (SELECT f.*, feature, CASE WHEN a + b + c = 0 THEN NULL WHEN a >= b AND a >= c THEN 'number' WHEN b >= c THEN 'string' ELSE 'boolean' END AS kind FROM fields f LEFT JOIN named USING (plain)),
now AS (SELECT t.*, prev_id FROM typed t JOIN files USING (file_id) WHERE prev_id IS NOT NULL),
old AS (SELECT f.file_id, f.prev_id, t.field, t.plain, t.feature, t.kind FROM files f JOIN typed t ON t.file_id = f.prev_id),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.file_id = o.file_id AND n.field = o.field)),
fresh AS (SELECT * FROM now n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.file_id = o.file_id AND n.field = o.field)),
pairs AS (SELECT g.file_id, g.prev_id, g.field AS f0, n.field AS f1, g.kind AS k0, n.kind AS k1, g.plain = n.plain OR coalesce(g.feature = n.feature, false) AS by_name, g.feature IS NOT NULL AND n.feature IS NOT NULL AS both_resolve FROM gone g JOIN fresh n USING (file_id)),
held AS (SELECT file_id, account_reference, field, arg_max(num, coalesce(line_no, -1)) AS num, arg_max(words, coalesce(line_no, -1)) AS words, arg_max(num IS NOT NULL, coalesce(line_no, -1)) AS is_number
  FROM kv WHERE NOT missing AND account_reference IS NOT NULL GROUP BY ALL),
agreed AS (SELECT p.file_id, f0, f1, count(*) AS n, count(*) FILTER (WHERE CASE WHEN x.is_number AND y.is_number THEN x.num = y.num ELSE x.is_number = y.is_number AND x.words = y.words END) AS same FROM pairs p
  JOIN held x ON x.file_id = p.prev_id AND x.field = f0 JOIN held y ON y.file_id = p.file_id AND y.field = f1 AND x.account_reference = y.account_reference WHERE NOT by_name AND NOT both_resolve GROUP BY ALL),
renamed AS (SELECT p.file_id, f0, f1, k0, k1 FROM pairs p LEFT JOIN agreed USING (file_id, f0, f1) WHERE by_name OR coalesce(same >= 10 AND same * 10 >= 9 * n, false))
"""
_CHANGES = _RENAMES + """
SELECT file_id, 'renamed' AS change_kind, f0 AS field_name, f1 AS new_name FROM renamed
UNION ALL SELECT file_id, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.f0 = g.field)
UNION ALL SELECT file_id, 'added', field, '' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.f1 = g.field)
UNION ALL SELECT file_id, 'type_changed', field, '' FROM (SELECT n.file_id, n.field FROM now n JOIN old o USING (file_id, field) WHERE n.kind <> o.kind UNION SELECT file_id, f1 FROM renamed WHERE k0 <> k1)
UNION ALL SELECT d.file_id, 'miscounted', 'n_unexpected_columns', '' FROM organiser_dry_run d JOIN files f USING (file_id) WHERE n_unexpected_columns <> (SELECT count(*) FROM typed t WHERE t.file_id = d.file_id AND feature IS NULL)
"""
#: Columns of the one table: a field that resolves, else what its name or its renames lead back to.
_CELLS = _RENAMES.replace("WITH firsts", "WITH RECURSIVE firsts") + """
, linked AS (SELECT t.file_id, t.field, t.feature, f.prev_id AS up_file, coalesce(r.f0, t.field) AS up_field FROM typed t JOIN files f USING (file_id) LEFT JOIN renamed r ON r.file_id = t.file_id AND r.f1 = t.field),
goes AS (SELECT file_id, field, feature FROM linked WHERE feature IS NOT NULL UNION ALL SELECT l.file_id, l.field, g.feature FROM goes g JOIN linked l ON l.up_file = g.file_id AND l.up_field = g.field WHERE l.feature IS NULL),
cells AS (SELECT v.file_id, v.line_no, g.feature, r.value_kind, v.field, v.t, v.words, CASE WHEN r.value_kind IN ('code', 'date') THEN NULL WHEN v.t = 'BOOLEAN' THEN (v.s = 'true')::INT::DOUBLE ELSE v.num END AS number
  FROM kv v JOIN goes g USING (file_id, field) JOIN feature_registry r ON r.feature = g.feature WHERE NOT missing),
fit AS (SELECT * FROM cells WHERE value_kind IN ('code', 'date') OR number IS NOT NULL)
SELECT file_id, line_no, feature AS column_name, first(number ORDER BY field) AS number, first(CASE WHEN value_kind IN ('code', 'date') THEN words END ORDER BY field) AS words FROM fit GROUP BY ALL
"""
_METRICS = _VALUES + """
, has AS (SELECT DISTINCT file_id, feature FROM kv JOIN named USING (plain)),
vals AS (SELECT file_id, line_id, feature, first(s ORDER BY field) AS s, first(t ORDER BY field) AS t, first(num ORDER BY field) AS num, first(words ORDER BY field) AS words FROM kv JOIN named USING (plain) WHERE NOT missing GROUP BY ALL),
m AS (SELECT h.file_id, h.feature, any_value(r.value_kind) AS kind, any_value(n_lines) AS n_lines, CASE WHEN any_value(r.value_kind) IN ('amount', 'ratio', 'count') THEN count(DISTINCT v.num) ELSE count(DISTINCT coalesce('n' || v.num, 't' || v.words)) END AS n_distinct, 1 - count(v.line_id) / any_value(n_lines)::DOUBLE AS share, count(v.num) AS n, min(v.num) AS low, max(v.num) AS high, quantile_cont(v.num, 0.1) AS p10, quantile_cont(v.num, 0.5) AS p50, quantile_cont(v.num, 0.9) AS p90,
         count(*) FILTER (WHERE v.num < r.lo_bound - 1e-7 OR v.num > r.hi_bound + 1e-7) AS outside, count(*) FILTER (WHERE v.line_id IS NOT NULL AND v.num IS NULL) AS not_number, count(*) FILTER (WHERE v.line_id IS NOT NULL AND NOT (v.t = 'VARCHAR' AND coalesce(regexp_full_match(v.s, r.value_pattern), true))) AS bad_text
  FROM has h JOIN feature_registry r USING (feature) JOIN sizes USING (file_id) LEFT JOIN vals v USING (file_id, feature) GROUP BY h.file_id, h.feature),
p AS (SELECT m.*, prev_id, b.share AS share0, b.n AS n0, b.p10 AS p10_0, b.p50 AS p50_0, b.p90 AS p90_0, m.kind IN ('amount', 'ratio', 'count') AS is_number FROM m JOIN files USING (file_id) LEFT JOIN m b ON b.file_id = prev_id AND b.feature = m.feature)
"""
_ISSUES = _METRICS + """
SELECT file_id, feature AS column_name, 'null_rate' AS issue FROM p WHERE abs(share - share0) > 0.30 + 1e-7
UNION ALL SELECT file_id, feature, 'range' FROM p WHERE is_number AND outside > 0
UNION ALL SELECT file_id, feature, 'constant' FROM p WHERE is_number AND n >= 10 AND low = high
UNION ALL SELECT file_id, feature, 'pattern' FROM p WHERE is_number AND not_number > 0 OR kind IN ('code', 'date') AND bad_text > 0
UNION ALL SELECT file_id, feature, 'shift' FROM p WHERE is_number AND n >= 10 AND n0 >= 10 AND (p50 < p10_0 - 1e-7 OR p50 > p90_0 + 1e-7)
UNION ALL SELECT file_id, 'n_missing_required', CASE WHEN n_missing_required IS NULL THEN 'null_rate' ELSE 'range' END FROM organiser_dry_run WHERE n_missing_required IS NULL OR n_missing_required < 0 OR n_missing_required > (SELECT count(*) FROM feature_registry WHERE is_required)
UNION ALL SELECT file_id, 'schema_completeness', CASE WHEN schema_completeness IS NULL OR isnan(schema_completeness) THEN 'null_rate' ELSE 'range' END FROM organiser_dry_run WHERE schema_completeness IS NULL OR isnan(schema_completeness) OR schema_completeness < -1e-7 OR schema_completeness > 1 + 1e-7
"""


_PROFILE = _METRICS + """
, heads AS (SELECT file_id, min(source_name) AS source_name, min(file_seq) AS file_seq FROM score_requests WHERE file_id IS NOT NULL GROUP BY file_id),
q AS (SELECT p.*, source_name, file_seq, CASE WHEN is_number THEN n ELSE 0 END AS n_numbers FROM p JOIN heads USING (file_id)),
profile AS (
  SELECT file_id, source_name, file_seq, prev_id AS prev_file_id, feature AS column_name, kind AS value_kind, n_lines, round(share, 9) AS missing_share, n_distinct,
         CASE WHEN is_number THEN not_number WHEN kind IN ('code', 'date') THEN bad_text ELSE 0 END AS n_fault, CASE WHEN is_number THEN outside ELSE 0 END AS n_outside, n_numbers,
         CASE WHEN is_number THEN round(low, 6) END AS low, CASE WHEN is_number THEN round(p10, 6) END AS p10, CASE WHEN is_number THEN round(p50, 6) END AS p50, CASE WHEN is_number THEN round(p90, 6) END AS p90, CASE WHEN is_number THEN round(high, 6) END AS high,
         round(share0, 9) AS prev_missing_share, CASE WHEN is_number THEN n0 WHEN share0 IS NOT NULL THEN 0 END AS prev_n_numbers,
         CASE WHEN is_number THEN round(p10_0, 6) END AS prev_p10, CASE WHEN is_number THEN round(p50_0, 6) END AS prev_p50, CASE WHEN is_number THEN round(p90_0, 6) END AS prev_p90 FROM q)
"""
_LIMITS = _METRICS + """
, found AS (
  SELECT file_id, feature, 'null_rate' AS issue, share AS value, share0 - 0.30::DOUBLE AS low, share0 + 0.30::DOUBLE AS high FROM p
  UNION ALL SELECT file_id, feature, 'range', outside, NULL, 0 FROM p WHERE is_number UNION ALL SELECT file_id, feature, 'constant', 1, NULL, 0 FROM p WHERE is_number AND n >= 10 AND low = high
  UNION ALL SELECT file_id, feature, 'pattern', CASE WHEN is_number THEN not_number ELSE bad_text END, NULL, 0 FROM p WHERE is_number OR kind IN ('code', 'date')
  UNION ALL SELECT file_id, feature, 'shift', p50, p10_0, p90_0 FROM p WHERE is_number AND n >= 10 AND n0 >= 10)
SELECT file_id, feature AS column_name, issue, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM found WHERE value < low - 1e-7 OR value > high + 1e-7
"""
_CONTROL = _PROFILE + """
, long AS (SELECT file_id, source_name, file_seq, feature AS column_name, metric, value FROM (
  SELECT q.file_id, source_name, file_seq, feature, unnest(['missing_share', 'p50', 'n_distinct']) AS metric, unnest([share, CASE WHEN is_number THEN p50 END, n_distinct::DOUBLE]) AS value FROM q) WHERE value IS NOT NULL),
judged AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM long WINDOW w AS (PARTITION BY source_name, column_name, metric ORDER BY file_seq, file_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT file_id, column_name, metric, round(value, 6) AS value, round(mean, 6) AS mean, round(sd, 6) AS sd FROM judged WHERE n >= 5 AND abs(value - mean) > 3 * sd + 1e-7
"""


def oracle_sql() -> dict[str, str]:
    profile = _PROFILE + "SELECT * FROM profile"
    return {"p3_found": _CHANGES, "p3_cells": _CELLS, "p5_found": _ISSUES, "p5_limits": _LIMITS, "p5_profile": profile, "p5_incremental": profile, "p5_control": _CONTROL}
