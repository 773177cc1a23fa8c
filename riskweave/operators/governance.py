"""Checks by name, runs that may happen once, sealed runs and their metrics, faults of narratives, malformed frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Phrases that a narrative may not contain (fixed values).
FORBIDDEN_PHRASES = ("guilty", "criminal", "fraudster", "confirmed mule", "will be arrested")
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_violations, verdict): every named check is a table of its violations; an empty one passes."""
    zero = F.lit(0).cast("bigint")
    parts = [df.select(F.lit(1).alias("one")).agg(F.coalesce(F.count("one"), zero).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("verdict", F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return df.select(F.col(column).alias("k")).where("k IS NOT NULL").join(parents.select(F.col(key).alias("k")), "k", "left_anti")


def touch_once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """(name, attempt, is_refused): builds and stores a report the first time; a later attempt is logged and refused.

    The log only grows; the report is stored under the folder before the attempt is logged as done.
    """
    log = f"{folder}/log"
    schema = "name string, attempt int, is_refused boolean"
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    seen = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    attempts = spark.read.schema(schema).json(log).where(F.col("name") == name).count() if seen else 0
    if not attempts:
        build().write.mode("error").parquet(f"{folder}/{name}")
    spark.createDataFrame([(name, attempts + 1, attempts > 0)], schema).coalesce(1).write.mode("append").json(log)
    return spark.read.schema(schema).json(log).where(F.col("name") == name)


def list_seals(spark: SparkSession, folder: str) -> DataFrame:
    """(seal, key, n_rows) of every sealed run under a folder, by their manifests."""
    rows = spark.read.text(f"{folder}/*/manifest").select(F.input_file_name().alias("path"), "value")
    kinds = "key string, n_rows bigint"
    return rows.select(F.regexp_extract("path", r"([^/]+)/manifest/", 1).alias("seal"), F.from_json("value", kinds).alias("m")).select("seal", "m.*")


def sealed_metrics(spark: SparkSession, folder: str, labels: DataFrame, threshold: float, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """Confusion and its metrics of sealed predictions at a threshold, after the seal is verified and the labels are joined by the seal's key."""
    from .ranking import confusion, confusion_metrics

    return confusion_metrics(confusion(files.reveal(spark, folder, labels), keys, threshold, score, target))


def narrative_faults(text: Column, facts: Column, phrases: tuple[str, ...] = FORBIDDEN_PHRASES) -> Column:
    """Sorted array of faults of a JSON narrative {"text": ...}: NOT_JSON, NO_TEXT, NUMBER:<x> for numbers that no fact has, PHRASE:<x> for forbidden phrases.

    facts: array of the numbers that may be named, as texts.
    """
    body = F.from_json(text, "text string")["text"]
    plain = F.lower(body)
    numbers = F.array_except(F.regexp_extract_all(body, F.lit(f"({NUMBER})"), F.lit(1)), facts)
    found = F.concat(F.transform(numbers, lambda n: F.concat(F.lit("NUMBER:"), n)), F.array_compact(F.array(*(F.when(plain.contains(p), F.lit(f"PHRASE:{p}")) for p in phrases))))
    return F.when(text.isNull() | F.try_parse_json(text).isNull(), F.array(F.lit("NOT_JSON"))).when(body.isNull(), F.array(F.lit("NO_TEXT"))).otherwise(F.array_sort(found))


def malformations(df: DataFrame, key: str, number: str) -> dict[str, DataFrame]:
    """Nine variants of a frame that an intake has to notice, by name; each is a projection of the whole frame."""
    other = [c for c in df.columns if c not in (key, number)]
    text = F.col(number).cast("string")
    return {
        "intact": df,
        "column_missing": df.drop(number),
        "column_extra": df.withColumn("unexpected", F.lit(1)),
        "column_renamed": df.withColumnRenamed(number, f"{number}_v2"),
        "column_order": df.select(*reversed(df.columns)),
        "all_null": df.withColumn(number, F.lit(None).cast("double")),
        "text_in_numbers": df.withColumn(number, F.concat(text, F.lit(" units"))),
        "rows_repeated": df.unionByName(df),
        "empty": df.where(F.lit(False)),
        "case_of_headers": df.select(key, number, *(F.col(c).alias(c.swapcase()) for c in other)),
    }


def intake_verdict(df: DataFrame, required: list[str], key: str, number: str) -> DataFrame:
    """One row (n_missing, n_extra, n_rows, n_repeated, n_null, n_unreadable): what an intake notices about a frame."""
    names = set(df.columns)
    value = F.col(number).cast("string") if number in names else F.lit(None).cast("string")
    unread = value.isNotNull() & value.try_cast("double").isNull()
    return df.agg(
        F.lit(len(set(required) - names)).alias("n_missing"), F.lit(len(names - set(required))).alias("n_extra"), F.count(F.lit(1)).alias("n_rows"),
        (F.count(key) - F.count_distinct(key)).alias("n_repeated"), F.count_if(value.isNull()).alias("n_null"), F.count_if(unread).alias("n_unreadable"),
    )


def cached_table(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A stored table, and whether it had to be built: the first use writes it, later ones read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    hit = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not hit:
        build().write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder), not hit

