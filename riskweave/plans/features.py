"""Queries on the column dictionary, domain features and missingness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary as dic
from ..operators import features as ft
from ..session import read_table
from .fixtures import GRID, RAILS, WINDOWS, grid
from .registry import Registry

R = Registry()


def _case(patterns, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(variable_name, '{p}') THEN '{n}'" for n, p in patterns) + f" ELSE '{default}' END"


def _rails() -> str:
    """The rails in SQL: words as list members, stretches by contains."""
    tests = lambda words, stretches: " OR ".join([*(f"list_contains(string_split(variable_name, '_'), '{w}')" for w in words), *(f"contains(variable_name, '{s}')" for s in stretches)])
    return "CASE " + " ".join(f"WHEN {tests(w, s)} THEN '{n}'" for n, w, s in dic.RAILS) + " ELSE 'OTHER' END"


_W = [f"regexp_extract(variable_name, '{dic.WINDOW}', {i})" for i in range(1, 6)]
_WINDOW = f"CASE WHEN {_W[0]} <> '' AND {_W[1]} <> '' THEN 'L' || {_W[0]} || '_' || {_W[1]} || 'D' WHEN {_W[0]} <> '' THEN 'L' || {_W[0]} || 'D' WHEN {_W[2]} <> '' AND {_W[3]} <> '' THEN 'L' || {_W[2]} || '_' || {_W[3]} || 'D' WHEN {_W[4]} <> '' THEN 'L' || {_W[4]} || 'D' ELSE 'NONE' END"
_CR, _DB = f"regexp_matches(variable_name, '{dic.CREDIT}')", f"regexp_matches(variable_name, '{dic.DEBIT}')"
_WAY = f"CASE WHEN {_CR} AND NOT {_DB} THEN 'CREDIT' WHEN {_DB} AND NOT {_CR} THEN 'DEBIT' ELSE 'BOTH' END"
FACETS = f"""
WITH named AS (SELECT feature, variable_name, description, bank_finalized FROM feature_registry UNION ALL SELECT * FROM (VALUES
  ('X1', 'NON_CASH_CHQ_AMT_DB_L14D', 'amount', true), ('X2', 'STDNG_INSTR_TXNS_CR_L7_14D', 'Count of alerts raised', false), ('X3', 'CUST_RISK', 'Customer risk level', true),
  ('X4', 'ALERT_STATUS', 'Alert resolution status', true), ('X5', 'LABEL', 'target variable', false), ('X6', 'MM_UPI_XFER_7 TO 14DAYS_OCC', 'segment range', false)) v(feature, variable_name, description, bank_finalized)),
facets AS (SELECT feature, variable_name, bank_finalized, {_rails()} AS rail, {_case(dic.TRANSFORMS, 'LEVEL')} AS transform, {_WINDOW} AS win, {_WAY} AS way, upper(variable_name || ' ' || description) AS txt,
   CASE WHEN contains(lower(description), 'resolution status') THEN 'POST_RESOLUTION_LEAKAGE' WHEN contains(lower(description), 'target variable') THEN 'TARGET' WHEN contains(lower(description), 'customer risk level') THEN 'PRE_EXISTING_RISK_CONTEXT'
        WHEN contains(lower(description), 'alert description flag') OR starts_with(lower(description), 'count of alerts') THEN 'ALERT_CONTEXT' ELSE 'BEHAVIORAL' END AS availability FROM named),
full_facets AS (SELECT *, CASE WHEN availability IN ('POST_RESOLUTION_LEAKAGE', 'TARGET', 'INDEX_OR_ID') THEN 'QUARANTINED' WHEN availability IN ('PRE_EXISTING_RISK_CONTEXT', 'UNKNOWN_REVIEW') THEN 'REVIEW' ELSE 'SAFE' END AS leakage,
   array_to_string(list_sort(list_distinct(list_filter([rail, transform, CASE WHEN win <> 'NONE' THEN 'WINDOW_' || win END, CASE WHEN way <> 'BOTH' THEN way END, CASE WHEN regexp_matches(txt, 'AMT|AMOUNT') THEN 'AMOUNT' END,
     CASE WHEN regexp_matches(txt, '\\bTXN|TRANSACTION') THEN 'TRANSACTION_COUNT' END, CASE WHEN contains(txt, 'ALERT') THEN 'ALERT' END, CASE WHEN contains(txt, 'OCC') THEN 'OCCUPATION_SEGMENT' END,
     CASE WHEN contains(txt, 'SEGMENT') THEN 'SEGMENT' END, CASE WHEN win IN ('L7D', 'L7_14D') THEN 'SHORT_WINDOW' END, CASE WHEN win IN ('L31D', 'L14_31D', 'L7_31D') THEN 'LONG_WINDOW' END], lambda x: x IS NOT NULL))), ',') AS tags FROM facets)
"""


def _named(spark: SparkSession, folder: str) -> DataFrame:
    extra = [
        ("X1", "NON_CASH_CHQ_AMT_DB_L14D", "amount", True), ("X2", "STDNG_INSTR_TXNS_CR_L7_14D", "Count of alerts raised", False), ("X3", "CUST_RISK", "Customer risk level", True),
        ("X4", "ALERT_STATUS", "Alert resolution status", True), ("X5", "LABEL", "target variable", False), ("X6", "MM_UPI_XFER_7 TO 14DAYS_OCC", "segment range", False),
    ]
    schema = "feature string, variable_name string, description string, bank_finalized boolean"
    return read_table(spark, folder, "feature_registry").select("feature", "variable_name", "description", "bank_finalized").union(spark.createDataFrame(extra, schema))


def facets(spark: SparkSession, folder: str) -> DataFrame:
    """The registry with what its names say."""
    v, d = F.col("variable_name"), F.col("description")
    known = dic.availability(F.col("feature"), d)
    return _named(spark, folder).select(
        "feature", "variable_name", "bank_finalized", dic.rail(v).alias("rail"), dic.transform(v).alias("transform"), dic.window(v).alias("win"), dic.direction(v).alias("way"), known.alias("availability"),
        dic.leakage_status(known).alias("leakage"), F.array_join(dic.tags(v, d), ",").alias("tags"),
    )


@R.add(FACETS + "SELECT feature, variable_name, bank_finalized, rail, transform, win, way, availability, leakage, tags FROM full_facets")
def dict_facets(spark: SparkSession, folder: str) -> DataFrame:
    """DIC-01..07, SRC-09: rail, transform, window, direction, availability, tags."""
    return facets(spark, folder)


@R.add(FACETS + "SELECT availability, leakage, rail, transform, count(*) AS n FROM full_facets GROUP BY GROUPING SETS ((availability), (leakage), (rail), (transform))")
def dict_counts_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """DIC-08, SRC-10, EXT-60: four counts of the registry in one pass."""
    f = facets(spark, folder)
    a, leak, rail, tr = (F.col(c) for c in ("availability", "leakage", "rail", "transform"))
    return f.groupingSets([[a], [leak], [rail], [tr]], a, leak, rail, tr).agg(F.count(F.lit(1)).alias("n"))


@R.add(FACETS + f"SELECT feature, nullif(regexp_extract(variable_name, '{dic.STEM}', 1), '') AS stem FROM named")
def dict_stems(spark: SparkSession, folder: str) -> DataFrame:
    """DIC-09: names without their window."""
    return _named(spark, folder).select("feature", dic.stem(F.col("variable_name")).alias("stem"))


_ADMIT = FACETS + """
, ruled AS (SELECT feature, rail, availability, CASE WHEN feature = 'F0902' THEN 'HARD_QUARANTINE' WHEN availability IN ('TARGET', 'POST_RESOLUTION_LEAKAGE', 'INDEX_OR_ID') THEN 'FORBIDDEN_CLASS'
   WHEN feature = 'F0911' THEN 'CONDITIONAL_QUARANTINE' WHEN feature = 'F0938' THEN 'FAIRNESS_EXCLUDED' WHEN availability NOT IN ('BEHAVIORAL', 'ALERT_CONTEXT') THEN 'CLASS_NOT_IN_VIEW' WHEN {fin} AND NOT bank_finalized THEN 'NOT_BANK_FINALIZED'
   WHEN {fam} AND rail NOT IN ('UPI', 'CASH', 'ATM') THEN 'FAMILY_NOT_IN_VIEW' END AS reason FROM full_facets)
"""


def _policy(**view):
    from ..operators import firewall as fw

    return fw.Policy(hard=("F0902",), conditional=("F0911",), fairness=("F0938",), allow=("BEHAVIORAL", "ALERT_CONTEXT"), **view)


@R.add(_ADMIT.format(fin="false", fam="false") + "SELECT feature, reason, reason IS NULL AS is_admitted FROM ruled")
def firewall_admit(spark: SparkSession, folder: str) -> DataFrame:
    """FW-01/02: which columns may be used, and why others may not."""
    from ..operators import firewall as fw

    return fw.judge(facets(spark, folder), _policy()).select("feature", "reason", F.col("reason").isNull().alias("is_admitted"))


@R.add(_ADMIT.format(fin="true", fam="true") + "SELECT coalesce(reason, 'ADMITTED') AS outcome, rail, count(*) AS n FROM ruled GROUP BY ALL")
def firewall_views(spark: SparkSession, folder: str) -> DataFrame:
    """FW-03: a named view, limited to finalized columns of some rails."""
    from ..operators import firewall as fw

    ruled = fw.judge(facets(spark, folder), _policy(finalized_only=True, families=("UPI", "CASH", "ATM")))
    return ruled.groupBy(F.coalesce("reason", F.lit("ADMITTED")).alias("outcome"), "rail").agg(F.count(F.lit(1)).alias("n"))


_COLUMNS = ["user_id", *(f"{r}_AMT_{d}_L{w}D" for r in ("UPI", "ATM", "CASH") for d in ("CR", "DB") for w in WINDOWS)]


@R.add(GRID + "SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLUMNS[1:]) + ", COUNT_TXNS_L31D, COUNT_NIGHT_TXNS_L31D FROM grid")
def window_grid(spark: SparkSession, folder: str) -> DataFrame:
    """META inputs: amounts per account by rail, direction and window in one aggregate."""
    return grid(spark, folder).select("user_id", *(F.round(c, 6).alias(c) for c in _COLUMNS[1:]), "COUNT_TXNS_L31D", "COUNT_NIGHT_TXNS_L31D")


def _meta_input(spark: SparkSession, folder: str) -> DataFrame:
    g = grid(spark, folder)
    return g.withColumns({
        "NIGHT_ALERTS": F.col("COUNT_NIGHT_TXNS_L31D"), "COUNT_ALERTS": F.col("COUNT_TXNS_L31D"), "HIGH_VALUE_UPI_DB_TXNS": F.col("ALERT_0"), "MULTI_PG_TXNS": F.col("ALERT_1"), "FAILED_UPI_TXNS": F.col("ALERT_2"),
        "RISKY_COUNTRY_TXNS": F.col("ALERT_3"), "D_AVG_BAL_7DAYS_OCC": F.col("AVG_BAL_7DAYS") / 100 - 1, "D_AVG_BAL_31DAYS_OCC": F.col("AVG_BAL_31DAYS") / 100 - 1, "POS_PYMT_TXNS_L31D": F.col("POS_PYMT_AMT_DB_L31D"),
        "TENURE_AS_OF_ALERT": F.col("user_id") % 6, "TOT_TXNS_L7D": F.col("TOT_TXNAMT_CR_L7D") / 10, "TOT_TXNS_L31D": F.col("TOT_TXNAMT_CR_L31D") / 10,
    })


def _clip(e: str, low: float, high: float) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {low}::DOUBLE), {high}::DOUBLE) END"


def _ratio(a: str, b: str) -> str:
    return _clip(f"({a}) / (abs({b}) + 1e-6::DOUBLE)", 0, 100)


_MG = {
    "MG_PASSTHROUGH_7D": _ratio("TOT_TXNAMT_DB_L7D", "TOT_TXNAMT_CR_L7D"),
    "MG_PASSTHROUGH_31D": _ratio("TOT_TXNAMT_DB_L31D", "TOT_TXNAMT_CR_L31D"),
    "MG_RETENTION_RATIO": _ratio("AVG_BAL_7DAYS", "TOT_TXNAMT_CR_L7D"),
    "MG_BURST_7_31": _clip("(TOT_TXNAMT_CR_L7D / 10) / (abs(TOT_TXNAMT_CR_L31D / 10) + 1e-6::DOUBLE) - 7.0::DOUBLE / 31", -1, 5),
    "MG_BURST_AMT_7_31": _clip("TOT_TXNAMT_DB_L7D / (abs(TOT_TXNAMT_DB_L31D) + 1e-6::DOUBLE) - 7.0::DOUBLE / 31", -1, 5),
    "MG_RAIL_FRAGMENTATION": " + ".join(f"(coalesce({r}_AMT_DB_L7D, 0) > 0)::INT::DOUBLE" for r in RAILS.values()),
    "MG_CASHOUT_PRESSURE": _ratio("coalesce(CASH_AMT_DB_L7D, 0) + coalesce(ATM_AMT_DB_L7D, 0)", "TOT_TXNAMT_CR_L7D"),
    "MG_BALANCE_DRAIN": _ratio("TOT_TXNAMT_DB_L7D", "AVG_BAL_7DAYS"),
    "MG_NEW_ACCOUNT_ACTIVITY": _clip("ln(1 + coalesce(ELEC_XFER_AMT_DB_L7D, 0) + coalesce(UPI_AMT_DB_L7D, 0)) * (365.0::DOUBLE / (CASE upper(trim(ACCT_OPN_BUCKET)) WHEN 'L7D' THEN 7 WHEN 'L14D' THEN 14 WHEN 'L31D' THEN 31 WHEN 'L90D' THEN 90 WHEN 'L180D' THEN 180 WHEN 'L365D' THEN 365 WHEN 'G365D' THEN 730 END + 365))", 0, 50),
    "MG_PROFILE_MISMATCH": "ln(1 + (abs(AVG_BAL_7DAYS / 100 - 1) + abs(AVG_BAL_31DAYS / 100 - 1)) / 2)",
    "MG_ALERT_CONVERGENCE": " + ".join(f"(ALERT_{h} > 0)::INT::DOUBLE" for h in range(4)),
    "MG_ODD_HOUR_ALERT_RATIO": "COUNT_NIGHT_TXNS_L31D / greatest(COUNT_TXNS_L31D, 1)",
    "MG_MERCHANT_LEGITIMACY": "(coalesce(POS_PYMT_AMT_DB_L31D, 0) > 0)::INT::DOUBLE + (user_id % 6 >= 3)::INT::DOUBLE + (AVG_BAL_7DAYS / (abs(TOT_TXNAMT_CR_L7D) + 1e-6::DOUBLE) > 0.25)::INT::DOUBLE",
}
_META = GRID + ", meta AS (SELECT user_id, " + ", ".join(f"{e} AS {n}" for n, e in _MG.items()) + " FROM grid)\n"


@R.add(_META + "SELECT user_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _MG) + " FROM meta")
def meta_features(spark: SparkSession, folder: str) -> DataFrame:
    """META-00..15: the thirteen domain features."""
    made = ft.with_meta(_meta_input(spark, folder))
    return made.select("user_id", *(F.round(n, 6).alias(n) for n in _MG))


@R.add(_META + "SELECT feature, round(avg((value IS NOT NULL)::INT), 4) AS coverage FROM meta UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(_MG) + ")) GROUP BY feature")
def meta_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """META-16: share of rows with each feature."""
    return ft.coverage(ft.with_meta(_meta_input(spark, folder)), list(_MG))


_CARDS = " UNION ALL ".join(
    f"SELECT user_id, '{n}' AS card, round({f}, 6) AS observed, round(least(1, {f'({f} - {c}::DOUBLE)' if w == 'above' else f'({c}::DOUBLE - {f})'} / {s}::DOUBLE), 6) AS confidence FROM meta WHERE {f} {'>' if w == 'above' else '<'} {c}::DOUBLE"
    for n, f, c, w, s in ft.TYPOLOGIES
)


@R.add(_META + _CARDS)
def pattern_cards(spark: SparkSession, folder: str) -> DataFrame:
    """META-17/18: the typologies each account supports."""
    cards = ft.typology_cards(ft.with_meta(_meta_input(spark, folder)), "user_id")
    return cards.select("user_id", "card", F.round("observed", 6).alias("observed"), F.round("confidence", 6).alias("confidence"))


_FAMILIES = {r: [f"{r}_AMT_{d}_L{w}D" for d in ("CR", "DB") for w in WINDOWS] for r in ("UPI", "ATM", "CASH")}
_ALL = [c for own in _FAMILIES.values() for c in own]
_PAIRS = {f"{r}_{a}_{b}": [(f"{r}_AMT_{d}_L{a}D", f"{r}_AMT_{d}_L{b}D") for d in ("CR", "DB")] for r in _FAMILIES for a, b in ((7, 31), (7, 14), (14, 31))}
_N = lambda c: f"({c} IS NULL)::INT"


def _missing_sql() -> str:
    parts = [f"{_N(c)} AS MISS_{c}" for c in _ALL]
    for f, own in sorted(_FAMILIES.items()):
        parts += [f"{' + '.join(map(_N, own))} AS MISSN_{f}", f"({' + '.join(map(_N, own))}) / {len(own)}.0::DOUBLE AS MISSR_{f}"]
    for p, own in sorted(_PAIRS.items()):
        parts += [" + ".join(f"({a} IS NULL AND {b} IS NOT NULL)::INT" for a, b in own) + f" AS {p}_short_gap", " + ".join(f"({b} IS NULL AND {a} IS NOT NULL)::INT" for a, b in own) + f" AS {p}_long_gap"]
    total = " + ".join(map(_N, _ALL))
    return GRID + f"SELECT user_id, {', '.join(parts)}, {total} AS missing_total, ({total}) / {len(_ALL)}.0::DOUBLE AS missing_ratio FROM grid"


@R.add(_missing_sql())
def missing_block(spark: SparkSession, folder: str) -> DataFrame:
    """MISS-02/03/04: flags, family counts, window gaps and totals of missing values."""
    return ft.missing_block(grid(spark, folder), ["user_id"], _ALL, _FAMILIES, _PAIRS, _ALL)
