"""Exact quantiles of many groups without gathering a group.

Equal values are counted before the shuffle; the counts are spread over log-scaled
buckets of each group, whose totals (bounded in number) give every bucket its offset;
the values at the wanted places are then found inside their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bucket(value: Column, per_octave: int = 64) -> Column:
    """A bucket number that never falls as the value rises; fine near zero as well as far from it."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 2_000 * per_octave
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def value_counts(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, n) of the values that are neither null nor NaN."""
    v = F.col(value).cast("double")
    return rows.select(*keys, (v + 0.0).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def running_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, n, cum_n, total): counts summed from the lowest value up."""
    marked = counts.withColumn("__b", value_bucket(F.col("value")))
    before = Window.partitionBy(*keys).orderBy("__b")
    sums = marked.groupBy(*keys, "__b").agg(F.sum("n").alias("__n"))
    offsets = sums.select(*keys, "__b", (F.sum("__n").over(before) - F.col("__n")).alias("__o"), F.sum("__n").over(Window.partitionBy(*keys)).alias("total"))
    up = Window.partitionBy(*keys, "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(offsets, [*keys, "__b"]).select(*keys, "value", "n", (F.col("__o") + F.sum("n").over(up)).alias("cum_n"), "total")


def linear_quantiles(counts: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """(keys, one column per fraction): quantiles by linear interpolation, as of (n - 1) * fraction."""
    run = running_counts(counts, keys)
    aggs = []
    for name, q in fractions.items():
        place = (F.col("total") - 1) * F.lit(q)
        low = F.floor(place)
        high = F.least(low + 1, F.col("total") - 1)
        at = lambda i: (F.col("cum_n") > i) & (F.col("cum_n") - F.col("n") <= i)
        aggs += [F.max(F.when(at(low), F.col("value"))).alias(f"__l_{name}"), F.max(F.when(at(high), F.col("value"))).alias(f"__h_{name}"), F.max(place - low).alias(f"__w_{name}")]
    got = run.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *((F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * F.col(f"__w_{n}")).alias(n) for n in fractions))
