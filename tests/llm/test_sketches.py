"""Sketches: stated error, merging, deletion, and the Spark operator against exact ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import sketches
from riskweave.llm.sketches import BITS, RANK_ERROR, DyadicSketch

RNG = np.random.default_rng(5)
COLUMNS = {
    "uniform": RNG.integers(0, 1 << BITS, 200_000), "lognormal": np.minimum((1 << BITS) - 1, (RNG.lognormal(0, 2, 200_000) * 3000).astype(int)),
    "ties": np.where(RNG.random(200_000) < 0.4, 777_777, RNG.integers(0, 1 << BITS, 200_000)), "few": RNG.integers(0, 3000, 50_000),
    "two lumps": np.concatenate((RNG.integers(0, 5000, 90_000), RNG.integers(900_000, 905_000, 90_000))),
}


def worst(codes, sketch):
    fractions = np.arange(1, 100) / 100
    got, order, ranks = sketch.invert(fractions), np.sort(codes), np.ceil(fractions * len(codes))
    return max(0, *(np.searchsorted(order, got, "left") + 1 - ranks), *(ranks - np.searchsorted(order, got, "right"))) / len(codes)


def built(codes, sign=1):
    return DyadicSketch().add(codes, np.full(len(codes), sign, np.int64))


@pytest.mark.parametrize("name", COLUMNS)
def test_error_is_within_the_stated_bound(name):
    codes = COLUMNS[name]
    merged = DyadicSketch()
    for part in np.array_split(codes, 7):
        merged.merge(DyadicSketch.load(built(part).dump()))
    assert merged.size() == len(codes) and worst(codes, merged) <= (RANK_ERROR if merged.exact is not None else 0)


@pytest.mark.parametrize("name", COLUMNS)
def test_counters_alone_are_within_the_stated_bound(name):
    """No sketch stays sparse, however few its codes; small groups as well."""
    for codes in (COLUMNS[name], COLUMNS[name][:300], COLUMNS[name][:7]):
        merged = DyadicSketch(0)
        for part in np.array_split(codes, 3):
            merged.merge(DyadicSketch.load(DyadicSketch(0).add(part, np.ones(len(part), np.int64)).dump(), 0))
        assert merged.exact is not None and merged.size() == len(codes)
        assert worst(codes, merged) <= max(RANK_ERROR, 1 / len(codes))


def test_merging_order_does_not_matter():
    a, b, c = np.array_split(COLUMNS["lognormal"], 3)
    left, right = built(a).merge(built(b)).merge(built(c)), built(c).merge(built(a).merge(built(b)))
    assert (left.exact == right.exact).all() and (left.signed == right.signed).all()


def test_deletions_undo_additions():
    keep, drop = np.array_split(COLUMNS["uniform"], 2)
    held = built(np.concatenate((keep, drop))).merge(built(drop, -1))
    assert held.size() == len(keep) and worst(keep, held) <= RANK_ERROR
    assert built(keep[:50]).merge(built(keep[:50], -1)).size() == 0


def test_empty_sketch():
    assert list(DyadicSketch().invert([0.5])) == [-1]


def test_operator(spark):
    rows = [("a", float(i % 97), float(i) / 5000) for i in range(5000)] + [(None, None, float("nan")), ("b", 101.0, -0.1), ("a", None, 0.5)] + [("c", 50.0, 0.25)] * 3
    df = spark.createDataFrame(rows, "k string, x double, y double").withColumn("metric", F.lit("clash"))
    codes = {"x": sketches.encoded(F.col("x"), 0, 100), "y": sketches.encoded(F.col("y"), 0, 1)}
    fractions, ranges = {"p25": 0.25, "p50": 0.5}, {"x": (0.0, 100.0), "y": (0.0, 1.0)}
    whole = sketches.build_sketches(df.repartition(5), ["k"], codes)
    got = {(r.k, r.metric): r for r in sketches.percentiles(whole, ["k"], ranges, fractions).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("c", "x"), ("c", "y")}
    assert got["a", "x"].n == 5000 and got["a", "x"].p50 == pytest.approx(sorted(float(i % 97) for i in range(5000))[2499], abs=1e-4)
    assert got["a", "y"].n == 5001 and abs(got["a", "y"].p25 - 0.25) < RANK_ERROR
    assert got["c", "y"].p50 == pytest.approx(0.25, abs=1e-6)
    minus = sketches.build_sketches(df.where("k = 'c'"), ["k"], codes, F.lit(-1))
    left = sketches.percentiles(sketches.merge_sketches(whole.union(minus), ["k"]), ["k"], ranges, fractions)
    assert {r.k for r in left.collect()} == {"a"}
    assert sketches.build_sketches(df.limit(0), ["k"], codes).count() == 0


def test_days_combine_into_periods(spark):
    df = spark.range(20_000).select((F.col("id") % 10).alias("day"), (F.xxhash64("id") % 1000 / 2000.0 + 0.5).alias("y"))
    codes, ranges = {"y": sketches.encoded(F.col("y"), 0, 1)}, {"y": (0.0, 1.0)}
    days = sketches.build_sketches(df, ["day"], codes).withColumn("period", F.lit(1))
    one = sketches.percentiles(sketches.merge_sketches(days, ["period"]), ["period"], ranges, {"m": 0.5}).first()
    exact = sorted(r.y for r in df.select("y").collect())[math.ceil(20_000 / 2) - 1]
    assert one.n == 20_000 and one.m == pytest.approx(exact, abs=1e-6)


def test_workers_pass_partials_on_when_full(monkeypatch):
    monkeypatch.setattr(sketches, "WORKER_CODES", 20_000)
    rng, whole, merged = np.random.default_rng(4), {}, {}
    held = sketches._Partials(["x", "y"])

    def flush():
        for name, metric, sketch in held.rows():
            merged.setdefault((name, metric), DyadicSketch()).merge(DyadicSketch.load(sketch.dump()))

    for _ in range(30):
        number, names = rng.integers(0, 3, 3000), [("a", None), ("b", 1), (None, 2)]
        codes = [rng.integers(-1, 1 << BITS, 3000), rng.integers(-1, 50, 3000)]
        held.take(number, names, codes, np.ones(3000, np.int64))
        for m, code in zip("xy", codes):
            for g, name in enumerate(names):
                whole.setdefault((name, m), []).append(code[(number == g) & (code >= 0)])
        if held.full():
            flush()
            held = sketches._Partials(["x", "y"])
    flush()
    assert set(whole) == set(merged)
    for key, parts in whole.items():
        codes = np.concatenate(parts)
        assert merged[key].size() == len(codes) and worst(codes, merged[key]) <= RANK_ERROR
