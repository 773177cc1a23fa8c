"""From dirty text to typed columns; headers, identifiers, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import BLANKS

#: Date formats, first that fits wins (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM-dd-yyyy", "dd/MM/yyyy")
#: Names of columns that number rows (fixed values).
INDEX_NAMES = ("index", "row_index", "row_id", "unnamed: 0", "id")


def cleaned(column: str | Column) -> Column:
    """Trimmed text; NA is null."""
    c = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))
    return F.when(c != "NA", c)


def parsed_date(text: Column) -> Column:
    """Date by the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS))


def column_report(df: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """(column, n_na, n_values, n_unparsed, kind): what every text column is, by one aggregate over all of them.

    Numbers where all values but NA parse, dates where named, else categories.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    aggs = []
    for c in texts:
        value = cleaned(c)
        good = parsed_date(value) if c in dates else value.try_cast("double")
        aggs.append(F.struct(F.count_if(F.btrim(F.col(c), F.lit(BLANKS)) == "NA").alias("n_na"), F.count(value).alias("n_values"), F.count_if(value.isNotNull() & good.isNull()).alias("n_unparsed")).alias(c))
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, n_na bigint, n_values bigint, n_unparsed bigint, kind string")
    long = df.agg(*aggs).unpivot([], texts, "column", "x").select("column", "x.*")
    kind = F.when(F.col("column").isin(*dates), "date") if dates else F.when(F.lit(False), "date")
    return long.withColumn("kind", kind.when(F.col("n_unparsed") == 0, "number").otherwise("category"))


def canonicalise(df: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """Text columns typed as `column_report` finds (read once, one small row); other columns pass."""
    kinds = {r["column"]: r["kind"] for r in column_report(df, dates).collect()}  # one row a column
    typed = {"number": lambda c: cleaned(c).try_cast("double"), "date": lambda c: parsed_date(cleaned(c)), "category": cleaned}
    return df.select(*(typed[kinds[c]](c).alias(c) if c in kinds else F.col(c) for c in df.columns))


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of a stated schema (number, date, category); absent, NA, empty and unreadable values are null."""
    out = []
    for name, kind in kinds.items():
        value = F.nullif(cleaned(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit(None).cast("string")
        out.append((value.try_cast("double") if kind == "number" else parsed_date(value) if kind == "date" else value).alias(name))
    return df.select(*out)


def ordinal_levels(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values in sorted order; numbered within pieces of equal first characters, so that no task sorts all."""
    from pyspark.sql import Window

    levels = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__p", F.substring(column, 1, 2))
    sizes = levels.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))  # one row a piece
    inside = Window.partitionBy("__p").orderBy(column)
    return levels.join(offsets, "__p").select(column, (F.col("__o") + F.row_number().over(inside) - 1).cast("double").alias("code"))


def ordinal_encode(df: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """The rows with <column>_code: the level's number, -1 for unseen values, null for null."""
    code = levels.withColumnRenamed("code", f"{column}_code")
    joined = df.join(code, column, "left")
    return joined.withColumn(f"{column}_code", F.when(F.col(column).isNotNull(), F.coalesce(f"{column}_code", F.lit(-1.0))))


def resolve_headers(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """(header, feature, status) of (header) against (feature, variable_name): MAPPED, UNKNOWN, AMBIGUOUS (several features) or COLLISION (a target taken twice).

    Names match exactly in upper case without all but letters and digits; refused headers have no feature.
    """
    from pyspark.sql import Window

    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")
    alias = registry.select("feature", F.explode(F.array("feature", "variable_name")).alias("name")).select(plain("name").alias("k"), "feature").distinct()
    index = alias.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("feature").alias("target"))
    hit = headers.withColumn("k", plain("header")).join(index, "k", "left")
    taken = F.count(F.when(F.col("n") == 1, F.col("target"))).over(Window.partitionBy(F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("header"))))
    status = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") > 1, "AMBIGUOUS").when(taken > 1, "COLLISION").otherwise("MAPPED")
    return hit.withColumn("status", status).select("header", F.when(F.col("status") == "MAPPED", F.col("target")).alias("feature"), "status")


def schema_integrity(df: DataFrame, required: list[str], numeric: list[str]) -> DataFrame:
    """One row: missing and extra columns, all-null columns, numeric columns mostly unreadable, repeated rows, and PASS, WARN or FAIL."""
    have = set(df.columns)
    missing, extra = sorted(set(required) - have), sorted(have - set(required))
    present = [c for c in required if c in have]
    bad = [F.count_if(cleaned(F.col(c).cast("string")).isNotNull() & cleaned(F.col(c).cast("string")).try_cast("double").isNull()).alias(f"__b{i}") for i, c in enumerate(n for n in numeric if n in have)]
    nulls = [F.count(F.col(c)).alias(f"__n{i}") for i, c in enumerate(present)]
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c")).agg(F.sum("__c").alias("n_rows"), F.sum(F.col("__c") - 1).alias("n_repeated"))
    one = df.agg(*nulls, *bad, F.count(F.lit(1)).alias("__all")).crossJoin(sizes)
    n = F.greatest(F.col("__all"), F.lit(1))
    all_null = sum(((F.col(f"__n{i}") == 0).cast("int") for i in range(len(nulls))), F.lit(0))
    unread = sum(((F.col(f"__b{i}") / n > 0.5).cast("int") for i in range(len(bad))), F.lit(0))
    status = F.when(F.lit(bool(missing)), "FAIL").when((all_null > 0) | (unread > 0) | (F.col("n_repeated") > 0) | F.lit(bool(extra)), "WARN").otherwise("PASS")
    return one.select(F.lit(",".join(missing)).alias("missing"), F.lit(",".join(extra)).alias("extra"), all_null.alias("n_all_null"), unread.alias("n_unreadable"), "n_repeated", status.alias("status"))


def index_columns(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(column, is_index): columns whose values run 0..n-1 or 1..n in file order, or whose name says so. row: the dense place from 0."""
    tests = [F.struct(F.bool_and(F.coalesce(F.col(c) == F.col(row), F.lit(False))).alias("a"), F.bool_and(F.coalesce(F.col(c) == F.col(row) + 1, F.lit(False))).alias("b")).alias(c) for c in columns]
    return df.agg(*tests).unpivot([], columns, "column", "x").select("column", (F.col("x.a") | F.col("x.b") | F.lower("column").isin(*INDEX_NAMES)).alias("is_index"))


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet can't take for a formula: an apostrophe before = + - @, tab and carriage return."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def submission(rows: DataFrame, row: str, score: str, threshold: float | None = None) -> DataFrame:
    """(id, prediction): the score to 6 places half-even, or 0/1 at a threshold."""
    value = F.bround(F.col(score), 6) if threshold is None else (F.col(score) >= threshold).cast("int")
    return rows.select(F.col(row).alias("id"), value.alias("prediction"))


def submission_checks(df: DataFrame, n_expected: int, binary: bool = False) -> DataFrame:
    """One row of violation counts: size, nulls, repeated ids, values outside 0..1 (or not 0/1)."""
    p = F.col("prediction")
    bad = ~p.isin(0, 1) if binary else ~p.between(0, 1)
    return df.agg(
        (F.count(F.lit(1)) - n_expected).alias("n_size_off"), F.count_if(F.col("id").isNull() | p.isNull()).alias("n_null"), (F.count("id") - F.count_distinct("id")).alias("n_repeated_ids"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_out_of_range")
    )


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows and an order-free digest of the contents."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*columns)).alias("digest"), F.sum(F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1 << 31))).alias("check"))
