"""Group-aware splits and samples, ordered by an arithmetic hash that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import linear_quantiles, value_counts

#: The hash's modulus, a prime (fixed value), and the number of pieces in which an order is numbered.
MODULUS, PIECES = 2_147_483_647, 10_007


def shuffle_hash(key: Column, seed: int | Column) -> Column:
    """A number of 0..MODULUS-1 that orders integer keys at random, in whole-number arithmetic that any engine can repeat.

    It is not linear in key or seed: orders of two seeds have nothing to do with each other.
    """
    k = F.pmod(key.cast("bigint"), F.lit(MODULUS).cast("bigint"))
    x = F.pmod(k * 7919 + (seed if isinstance(seed, Column) else F.lit(seed)).cast("bigint") * 104729, F.lit(MODULUS).cast("bigint"))
    y = F.pmod(x * x + k, F.lit(MODULUS).cast("bigint"))
    return F.pmod(y * 48271 + F.pmod(y * y, F.lit(MODULUS).cast("bigint")) + x, F.lit(MODULUS).cast("bigint"))


def shuffle_sql(key: str, seed: str) -> str:
    """The same in SQL."""
    k = f"(({key})::BIGINT % {MODULUS})"
    x = f"(({k} * 7919 + ({seed})::BIGINT * 104729) % {MODULUS})"
    y = f"(({x} * {x} + {k}) % {MODULUS})"
    return f"(({y} * 48271 + ({y} * {y}) % {MODULUS} + {x}) % {MODULUS})"


def numbered(df: DataFrame, keys: list[str], order: str, then: str, size: Column | None = None) -> DataFrame:
    """The rows with before, the sum of `size` (1 by default) of the key's rows ahead in order of (order, then), and all, the key's sum.

    order: a `shuffle_hash`. Pieces of its range are summed first (they are few), then each piece is numbered by itself.
    """
    own = F.lit(1) if size is None else size
    marked = df.withColumn("__size", own.cast("bigint")).withColumn("__piece", F.floor(F.col(order) / (MODULUS // PIECES)))
    ahead = Window.partitionBy(*keys).orderBy("__piece")
    sums = marked.groupBy(*keys, "__piece").agg(F.sum("__size").alias("__p"))
    offsets = sums.select(*keys, "__piece", (F.sum("__p").over(ahead) - F.col("__p")).alias("__o"), F.sum("__p").over(Window.partitionBy(*keys)).alias("all"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(order, then).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(offsets, [*keys, "__piece"]).withColumn("before", F.col("__o") + F.sum("__size").over(inside) - F.col("__size")).drop("__o", "__size", "__piece")


def row_groups(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(row, group_row): rows with equal values in all columns share the smallest row of theirs; nulls are equal to nulls, NaN to NaN, -0.0 to 0.0."""
    plain = [F.when(F.col(c).isNotNull(), F.col(c) + 0.0) if t == "double" else F.col(c) for c, t in df.dtypes if c in columns]
    digest = (F.xxhash64(*plain, *(F.col(c).isNull() for c in columns)), F.xxhash64(F.lit(3), *plain, *(F.col(c).isNull() for c in columns)))
    keyed = df.select(row, digest[0].alias("h1"), digest[1].alias("h2"))
    first = keyed.groupBy("h1", "h2").agg(F.min(row).alias("group_row"))
    return keyed.join(first, ["h1", "h2"]).select(row, "group_row")


def holdout(rows: DataFrame, group: str, target: str, fraction: float, seed: int) -> DataFrame:
    """(group, is_positive, n_rows, is_test): whole groups go to the test side, positive and other groups apart.

    Groups are taken in hash order while the rows taken before them are fewer than the fraction.
    """
    groups = rows.groupBy(group).agg(F.max(F.col(target)).cast("boolean").alias("is_positive"), F.count(F.lit(1)).alias("n_rows")).withColumn("__h", shuffle_hash(F.col(group), seed))
    placed = numbered(groups, ["is_positive"], "__h", group, F.col("n_rows"))
    return placed.select(group, "is_positive", "n_rows", (F.col("before") < F.col("all") * F.lit(fraction)).alias("is_test"))


def folds(groups: DataFrame, group: str, repeats: int, k: int, seed: int) -> DataFrame:
    """(group, rep, fold): stratified folds of groups, numbered round robin in each class's hash order.

    groups: (group, is_positive).
    """
    each = groups.select(group, "is_positive", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    hashed = each.withColumn("__h", shuffle_hash(F.col(group), F.col("rep") + seed))
    return numbered(hashed, ["rep", "is_positive"], "__h", group).select(group, "rep", (F.col("before") % k).cast("int").alias("fold"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both sides hold, and whether that is none."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n_shared")).withColumn("is_disjoint", F.col("n_shared") == 0)


def hard_negatives(rows: DataFrame, quantile: float = 0.98, ratio: int = 3, seed: int = 42, row: str = "row_index", score: str = "score", target: str = "target") -> DataFrame:
    """(row, kind): negatives at or above the quantile of the negatives' scores (HARD), `ratio` times as many others in hash order (BACKGROUND), and the positives."""
    negatives = rows.where(F.col(target) == 0)
    cut = linear_quantiles(value_counts(negatives.withColumn("__k", F.lit(1)), ["__k"], score), ["__k"], {"cut": quantile}).select("cut")
    marked = negatives.crossJoin(F.broadcast(cut)).withColumn("kind", F.when(F.col(score) >= F.col("cut"), "HARD").otherwise("BACKGROUND"))  # one row
    n_hard = marked.agg(F.count_if(F.col("kind") == "HARD").alias("n_hard"))
    placed = numbered(marked.withColumn("__h", shuffle_hash(F.col(row), seed)), ["kind"], "__h", row).crossJoin(F.broadcast(n_hard))  # one row
    kept = placed.where((F.col("kind") == "HARD") | (F.col("before") < ratio * F.col("n_hard"))).select(row, "kind")
    return kept.union(rows.where(F.col(target) == 1).select(row, F.lit("POSITIVE").alias("kind")))


def oversample(rows: DataFrame, ratio: float, seed: int, row: str = "row_index", target: str = "target") -> DataFrame:
    """The rows with copy_no: positives repeat (whole times plus a hash-drawn one) until they are `ratio` of the negatives."""
    sizes = rows.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q"))
    rate = F.greatest(F.lit(1.0), F.col("q") * ratio / F.greatest(F.col("p"), F.lit(1)))
    draw = (shuffle_hash(F.col(row), seed) + 0.5) / MODULUS
    copies = F.when(F.col(target) == 1, F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).otherwise(1)
    return rows.crossJoin(F.broadcast(sizes)).select(*rows.columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy_no"))  # one row


def undersample(rows: DataFrame, ratio: float, seed: int, row: str = "row_index", target: str = "target") -> DataFrame:
    """All positives, and in hash order as many negatives as make the positives `ratio` of them."""
    n = rows.agg(F.count_if(F.col(target) == 1).alias("__pos"))
    placed = numbered(rows.where(F.col(target) == 0).withColumn("__h", shuffle_hash(F.col(row), seed)), [target], "__h", row).crossJoin(F.broadcast(n))  # one row
    return rows.where(F.col(target) == 1).unionByName(placed.where(F.col("before") < F.ceil(F.col("__pos") / ratio)).select(*rows.columns))
