"""Row-wise domain features and the missingness encoding. Nothing here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Guard of the denominators, share of a week in a month, columns of the peer deviation (fixed values).
EPS = 1e-6
BURST_BASELINE = 7.0 / 31.0
PEER_COLUMNS = ("D_AVG_BAL_7DAYS_OCC", "D_AVG_BAL_14DAYS_OCC", "D_AVG_BAL_31DAYS_OCC", "D_AVG_BAL_7TO31DAYS_OCC")
#: Rails that fragment a trail (fixed values).
RAILS = ("UPI", "ELEC_XFER", "NET_BNKING", "MBNKING", "CASH", "ATM", "POS_PYMT", "BBPS", "NON_CASH_CHQ", "CHQ", "GST")
#: Alert flags that may converge (fixed values).
ALERT_FLAGS = (
    "HIGH_VALUE_UPI_DB_TXNS", "MULTI_DBS_FROM_ACCOUNT", "MULTI_PG_TXNS", "PWD_CHANGED_LARGE_FUND_XFERS", "RCVING_FUNDS_FROM_MULITPLE_USERS", "RISKY_COUNTRY_TXNS",
    "STATUS_CHANGE_AFTER_WD", "TXN_AT_UNUSUAL_TIME", "MULTI_UPI_DB_TXNS", "FAILED_UPI_TXNS", "ONE_TO_MANY_UPI_PAYMENTS",
)
#: Days that a tenure label stands for (fixed values).
TENURE_DAYS = {"L7D": 7.0, "L14D": 14.0, "L31D": 31.0, "L90D": 90.0, "L180D": 180.0, "L365D": 365.0, "G365D": 730.0}
#: Typologies: id, feature, threshold, direction, span (fixed values).
TYPOLOGIES = (
    ("passthrough_7d", "MG_PASSTHROUGH_7D", 1.0, "above", 1.0),
    ("passthrough_31d", "MG_PASSTHROUGH_31D", 1.0, "above", 1.0),
    ("low_retention", "MG_RETENTION_RATIO", 0.10, "below", 0.10),
    ("dormant_burst", "MG_BURST_7_31", 0.20, "above", 0.40),
    ("rail_fragmentation", "MG_RAIL_FRAGMENTATION", 4.0, "above", 6.0),
    ("cashout_pressure", "MG_CASHOUT_PRESSURE", 0.50, "above", 0.50),
    ("balance_drain", "MG_BALANCE_DRAIN", 3.0, "above", 7.0),
    ("new_account_activity", "MG_NEW_ACCOUNT_ACTIVITY", 0.60, "above", 0.40),
    ("profile_mismatch", "MG_PROFILE_MISMATCH", 2.0, "above", 4.0),
    ("alert_convergence", "MG_ALERT_CONVERGENCE", 3.0, "above", 5.0),
    ("odd_hour", "MG_ODD_HOUR_ALERT_RATIO", 0.50, "above", 0.50),
)


def clipped(value: Column, low: float, high: float) -> Column:
    """Value within low..high; null stays null (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / (|den| + EPS) within 0..100; null if either is."""
    return clipped(num / (F.abs(den) + EPS), 0.0, 100.0)


def tenure_days(label: Column) -> Column:
    """Days of a tenure label whatever its case and blanks; unknown labels give null."""
    table = F.create_map(*(F.lit(x) for pair in TENURE_DAYS.items() for x in pair))
    return F.try_element_at(table, F.upper(F.trim(label)))


class ColumnsByName:
    """Numeric columns of a frame by variable name; text is read leniently, an absent name is None."""

    def __init__(self, df: DataFrame, names: dict[str, str] | None = None):
        known = {c.upper(): c for c in reversed(df.columns)}
        self._of = known | {v.upper(): c for c, v in (names or {}).items() if c in df.columns}

    def __getitem__(self, name: str) -> Column | None:
        column = self._of.get(name.upper())
        return None if column is None else F.col(f"`{column}`").try_cast("double")

    def label(self, name: str) -> Column | None:
        column = self._of.get(name.upper())
        return None if column is None else F.col(f"`{column}`").cast("string")


def _sum(parts: list[Column | None]) -> Column | None:
    """Sum of the present columns with nulls as 0; None if there is none."""
    own = [F.coalesce(p, F.lit(0.0)) for p in parts if p is not None]
    return reduce(lambda a, b: a + b, own) if own else None


def _count_positive(parts: list[Column | None], least: float | None = None) -> Column | None:
    own = [F.coalesce(p, F.lit(0.0)) for p in parts if p is not None]
    return reduce(lambda a, b: a + b, [((p > 0) if least is None else (p >= least)).cast("double") for p in own]) if own else None


def meta_columns(df: DataFrame, names: dict[str, str] | None = None) -> dict[str, Column]:
    """The thirteen domain features as expressions; null where a needed column is absent.

    names: raw column -> variable name, for frames with coded headers.
    """
    c = ColumnsByName(df, names)

    def ratio(num: Column | None, den: Column | None) -> Column | None:
        return None if num is None or den is None else safe_ratio(num, den)

    def burst(kind: str) -> Column | None:
        s, long = c[f"TOT_{kind}_L7D"], c[f"TOT_{kind}_L31D"]
        return None if s is None or long is None else clipped(s / (F.abs(long) + EPS) - BURST_BASELINE, -1.0, 5.0)

    elec = _sum([c["ELEC_XFER_AMT_DB_L7D"], c["UPI_AMT_DB_L7D"]])
    label = c.label("ACCT_OPN_DAYS") if c.label("ACCT_OPN_DAYS") is not None else c.label("ACCT_OPN_BUCKET")
    peers = [F.abs(p) for n in PEER_COLUMNS if (p := c[n]) is not None]
    night, count = c["NIGHT_ALERTS"], c["COUNT_ALERTS"]
    bal, cr7 = c["AVG_BAL_7DAYS"], c["TOT_TXNAMT_CR_L7D"]
    business = [_count_positive([c["POS_PYMT_TXNS_L31D"]]), _count_positive([c["GST_TXNS_L31D"]]), _count_positive([c["TENURE_AS_OF_ALERT"]], 3.0)]
    if bal is not None and cr7 is not None:
        business.append((bal / (F.abs(cr7) + EPS) > 0.25).cast("double"))
    business = [b for b in business if b is not None]
    made = {
        "MG_PASSTHROUGH_7D": ratio(c["TOT_TXNAMT_DB_L7D"], cr7),
        "MG_PASSTHROUGH_31D": ratio(c["TOT_TXNAMT_DB_L31D"], c["TOT_TXNAMT_CR_L31D"]),
        "MG_RETENTION_RATIO": ratio(bal, cr7),
        "MG_BURST_7_31": burst("TXNS"),
        "MG_BURST_AMT_7_31": burst("TXNAMT_DB"),
        "MG_RAIL_FRAGMENTATION": _count_positive([c[f"{r}_AMT_DB_L7D"] if c[f"{r}_AMT_DB_L7D"] is not None else c[f"{r}_TXNS_DB_L7D"] for r in RAILS]),
        "MG_CASHOUT_PRESSURE": ratio(_sum([c["CASH_AMT_DB_L7D"], c["ATM_AMT_DB_L7D"]]), cr7),
        "MG_BALANCE_DRAIN": ratio(c["TOT_TXNAMT_DB_L7D"], bal),
        "MG_NEW_ACCOUNT_ACTIVITY": None if elec is None or label is None else clipped(F.log1p(elec) * (365.0 / (F.abs(tenure_days(label)) + 365.0)), 0.0, 50.0),
        "MG_PROFILE_MISMATCH": F.log1p(reduce(lambda a, b: a + b, peers) / len(peers)) if peers else None,
        "MG_ALERT_CONVERGENCE": _count_positive([c[f] for f in ALERT_FLAGS]),
        "MG_ODD_HOUR_ALERT_RATIO": None if night is None or count is None else F.coalesce(night, F.lit(0.0)) / F.greatest(F.coalesce(count, F.lit(0.0)), F.lit(1.0)),
        "MG_MERCHANT_LEGITIMACY": reduce(lambda a, b: a + b, business) if business else None,
    }
    return {name: F.lit(None).cast("double") if made_ is None else made_ for name, made_ in made.items()}


def with_meta(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Appends the domain features in one projection; features already there stay."""
    return df.withColumns({n: e for n, e in meta_columns(df, names).items() if n not in df.columns})


def fill_meta(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Like `with_meta`, but a supplied feature's nulls are filled with the derived value."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), e) if n in df.columns else e for n, e in meta_columns(df, names).items()})


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, coverage): the share of rows with a value, to 4 places."""
    one = df.agg(*(F.round(F.avg(F.col(c).isNotNull().cast("double")), 4).alias(c) for c in columns))
    return one.unpivot([], columns, "feature", "coverage")


def typology_cards(df: DataFrame, key: str) -> DataFrame:
    """(key, card, observed, confidence): the typologies a row's values support, confidence = min(1, excess / span)."""
    cards = []
    for name, feature, cut, way, span in TYPOLOGIES:
        if feature in df.columns:
            value = F.col(feature)
            excess = value - cut if way == "above" else cut - value
            cards.append(F.when(excess > 0, F.struct(F.lit(name).alias("card"), value.alias("observed"), F.least(F.lit(1.0), excess / span).alias("confidence"))))
    return df.select(key, F.explode(F.array_compact(F.array(*cards))).alias("c")).select(key, "c.*")


def missing_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of nulls per column: one aggregate row, used to choose columns (metadata)."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def flag_columns(rates: dict[str, float], low: float = 0.01, high: float = 0.99, most: int = 200) -> list[str]:
    """Columns that get a flag: rates within low..high, the `most` with the largest p(1-p), then in column order."""
    order = {c: i for i, c in enumerate(rates)}
    kept = sorted((c for c, p in rates.items() if low <= p <= high), key=lambda c: (-rates[c] * (1 - rates[c]), order[c]))[:most]
    return sorted(kept, key=order.__getitem__)


def missing_block(df: DataFrame, keys: list[str], flags: list[str], families: dict[str, list[str]], pairs: dict[str, list[tuple[str, str]]], columns: list[str]) -> DataFrame:
    """Flags per column, counts and ratios per family, window gaps per pair, and totals, in one projection.

    pairs: name -> (short window, long window) columns; *_short_gap counts short missing with long
    present, *_long_gap the reverse.
    """
    null = lambda c: F.col(c).isNull()
    count = lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    out = [null(c).cast("int").alias(f"MISS_{c}") for c in flags]
    for name, own in sorted(families.items()):
        out += [count([null(c) for c in own]).alias(f"MISSN_{name}"), (count([null(c) for c in own]) / float(len(own))).alias(f"MISSR_{name}")]
    for name, own in sorted(pairs.items()):
        out += [count([null(s) & ~null(l) for s, l in own]).alias(f"{name}_short_gap"), count([null(l) & ~null(s) for s, l in own]).alias(f"{name}_long_gap")]
    total = count([null(c) for c in columns])
    return df.select(*keys, *out, total.alias("missing_total"), (total / float(len(columns))).alias("missing_ratio"))
