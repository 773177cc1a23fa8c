"""Mixing sources to target weights (problem 7).

Tokens are added up per source in one scan (each partition sends one row per
source), repetition rates follow from the sums, and every document is emitted
floor(rate) times, plus once more with the probability of the rate's fraction,
drawn from a seeded hash of its id - the same on every run and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCAB
from .tokens import count_tokens

#: Seed of the hash that decides the fractional copy.
MIX_SEED = 20260707


def source_tokens(sized: DataFrame, source: str = "source") -> DataFrame:
    """(source_name, n_docs, n_tokens) per source; the null source is a source of its own."""
    return sized.groupBy(sized[source].alias("source_name")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def mixing_rates(per_source: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: how often its documents have to be used.

    total_tokens is the size of the whole corpus and of the mixture aimed at; wanted_tokens =
    target_weight * total_tokens; rate = wanted / n_tokens, at most max_repeats; is_capped tells
    whether the target is out of reach (also where the source has no token at all: rate 0).
    Null weights and caps count as 0. Sources without a target are in the total, but not in the
    result. Both inputs are one row a source.
    """
    total = per_source.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
    weight, cap = F.coalesce("target_weight", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))
    have, total_tokens = F.coalesce("n_tokens", F.lit(0)), F.col("total_tokens")
    joined = targets.select("source_name", "target_weight", "max_repeats").join(per_source, "source_name", "left").crossJoin(total)
    return joined.select(
        "source_name",
        weight.alias("target_weight"),
        cap.alias("max_repeats"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        have.alias("n_tokens"),
        total_tokens,
        (weight * total_tokens).alias("wanted_tokens"),
        (weight * total_tokens > cap * have).alias("is_capped"),
        F.when(have > 0, F.least(weight * total_tokens / F.when(have > 0, have), cap.cast("double"))).otherwise(0.0).alias("rate"),
    )


def draw_copies(sized: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = MIX_SEED) -> DataFrame:
    """(key, source_name, n_tokens, n_copies): floor(rate) copies plus a hash-seeded Bernoulli one.

    Documents of a null source or of one without a target get no row. No document is used more
    than max_repeats times: a capped rate is whole, so its fraction is zero.
    """
    rate = F.col("rate")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")
    plain = sized.select(F.col(key), F.col(source).alias("source_name"), "n_tokens")
    # rates has one row per target source; AQE broadcasts it when its measured size allows, else the skewed side is split
    return plain.join(rates.select("source_name", "rate"), "source_name").select(key, "source_name", "n_tokens", copies.alias("n_copies"))


def emit_copies(drawn: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per copy: (key, copy_no from 1, source_name, n_tokens)."""
    return drawn.where("n_copies > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy_no"), "source_name", "n_tokens")


def mixture_report(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: wanted and emitted tokens, documents, copies, and the actual share.

    actual_share is taken of the mixture as it came out, share_of_total of the size aimed at: where
    a capped source leaves the mixture smaller, the others still have their target share of the latter.
    """
    used = drawn.groupBy("source_name").agg(
        F.sum(F.col("n_copies") * F.col("n_tokens")).alias("emitted_tokens"),
        F.sum("n_copies").alias("emitted_docs"),
        F.max("n_copies").alias("most_copies"),
    )
    total = used.agg(F.sum("emitted_tokens").alias("mixture_tokens"))
    zero = F.lit(0).cast("bigint")
    return (
        rates.join(used, "source_name", "left")
        .crossJoin(total)
        .select(
            "source_name", "target_weight", "max_repeats", "n_docs", "n_tokens", F.round("rate", 6).alias("rate"), "is_capped",
            F.coalesce("emitted_docs", zero).alias("emitted_docs"),
            F.coalesce("emitted_tokens", zero).alias("emitted_tokens"),
            F.coalesce("most_copies", zero).alias("most_copies"),
            F.round(F.coalesce(F.coalesce("emitted_tokens", zero) / F.when(F.col("mixture_tokens") > 0, F.col("mixture_tokens")), F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(F.coalesce("emitted_tokens", zero) / F.when(F.col("total_tokens") > 0, F.col("total_tokens")), F.lit(0.0)), 6).alias("share_of_total"),
        )
    )


def sized_documents(documents: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    return count_tokens(documents, ["doc_id", "source"], vocab=vocab)


def draw_checks(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """(source_name, is_within, is_capped_right): whether the tokens drawn are within six standard deviations of rate * tokens, and no document beyond its cap."""
    fraction = F.col("rate") - F.floor("rate")
    used = drawn.join(rates.select("source_name", F.col("rate").alias("rate")), "source_name").groupBy("source_name").agg(
        F.sum(F.col("n_copies") * F.col("n_tokens")).alias("got"), F.sum(F.col("rate") * F.col("n_tokens")).alias("want"),
        F.sqrt(F.sum(F.col("n_tokens").cast("double") ** 2 * fraction * (1 - fraction))).alias("sd"), F.max("n_copies").alias("most"),
    )
    gap = F.abs(F.coalesce("got", F.lit(0)) - F.coalesce("want", F.lit(0.0)))
    return rates.join(used, "source_name", "left").select("source_name", (gap <= 6 * F.coalesce("sd", F.lit(0.0)) + 1e-6).alias("is_within"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("is_capped_right"))
