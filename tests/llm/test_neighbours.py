"""Neighbours against brute force: near copies, equal vectors, gaps, dense lumps."""

import json

import numpy as np
import pytest

from riskweave.llm import neighbours as nb
from riskweave.session import cut_lineage

WIDTH = 28
SCALE = np.linspace(0.5, 2.0, WIDTH)
NAMES = {f"f{i}": i for i in range(WIDTH)}
ROWS = "key string, features string, numbers array<double>"


def brute(keys, x, k=nb.NEIGHBOURS, radius=nb.RADIUS):
    out = set()
    for i in range(len(x)):
        d = [(float(nb.distances(x[i : i + 1], x[j : j + 1], SCALE)[0]), keys[j]) for j in range(len(x)) if j != i]
        out |= {(min(keys[i], other), max(keys[i], other)) for d2, other in sorted(d)[:k] if d2 <= radius**2}
    return out


def pairs(spark, keys, x, cell_rows=64):
    rows = spark.createDataFrame([(k, None, [None if v != v else float(v) for v in row]) for k, row in zip(keys, x)], ROWS)
    classes = cut_lineage(nb.vector_classes(rows, NAMES, WIDTH))
    index = nb.sample_index(classes, SCALE, by_mask=True, cell_rows=cell_rows)
    return {tuple(r) for r in nb.near_pairs(nb.member_neighbours(classes, nb.class_neighbours(classes, index, cut_lineage))).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.lognormal(0, 0.6, (150, WIDTH)) * SCALE
    lump = base[:1] + rng.normal(0, 0.004, (60, WIDTH)) * SCALE  # many vectors within the radius of one another
    near = base[:40] + rng.normal(0, 0.05, (40, WIDTH)) * SCALE
    x = np.concatenate((base, lump, near, base[:9], base[:3], np.repeat(base[5:6], 12, 0)))
    x[rng.random(x.shape) < 0.02] = np.nan
    x[-1, 5:] = np.nan  # too few coordinates
    keys = [f"k{i}" for i in rng.permutation(len(x))]
    whole = [i for i in range(len(x)) if np.isfinite(x[i]).sum() >= nb.LEAST_PRESENT]
    assert pairs(spark, keys, x) == brute([keys[i] for i in whole], x[whole])


def test_cells_do_not_matter(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (400, WIDTH))
    x = np.concatenate((base, base[:200] + rng.normal(0, 0.04, (200, WIDTH)) * SCALE))
    keys = [f"k{i}" for i in range(len(x))]
    assert pairs(spark, keys, x, 16) == pairs(spark, keys, x, 100_000) == brute(keys, x)


def test_reading_vectors(spark):
    full = {f"f{i}": i + 0.5 for i in range(WIDTH)}
    text = {**full, "f0": " 0.5 ", "f1": "NA", "f2": None, "f3": True, "extra": 1}
    rows = [("a", json.dumps(full), None), ("b", json.dumps(text), None), ("c", "broken", None), ("d", None, None), (None, json.dumps(full), None), ("e", None, [float("nan")] * WIDTH), ("f", None, [1.0] * 12), ("a", json.dumps(full), None)]
    classes = nb.vector_classes(spark.createDataFrame(rows, ROWS), NAMES, WIDTH).collect()
    got = {c.keys[0]: np.isfinite(np.frombuffer(c.vec)).sum() for c in classes}
    assert got == {"a": WIDTH, "b": WIDTH - 3, "f": 12} and all(len(c.keys) == 1 for c in classes)


def test_empty_and_single(spark):
    assert pairs(spark, [], np.zeros((0, WIDTH))) == set()
    assert pairs(spark, ["a"], np.ones((1, WIDTH))) == set()


@pytest.mark.parametrize("width", [12, 40, 70])
def test_any_width_of_the_registry(spark, width):
    fields = "feature string, variable_name string, vec_pos int, vec_scale double"
    registry = spark.createDataFrame([(f"F{i}", f"name_{i}", i, 0.5 + i) for i in range(width)] + [("flag", "FLAG", None, None)], fields)
    names, scale = nb.coordinates(registry)
    assert len(scale) == width and scale[width - 1] == width - 0.5 and names[f"name_{width - 1}"] == width - 1
    rng = np.random.default_rng(width)
    x = rng.normal(0, 1, (30, width)) * scale
    x = np.concatenate((x, x + 0.01 * scale * rng.normal(0, 1, x.shape)))
    x[5:35, width - 1] = np.nan
    texts = [json.dumps({(f"F{j}" if i % 2 else f"name_{j}"): None if v != v else float(v) for j, v in enumerate(row)}) for i, row in enumerate(x)]
    rows = [(f"k{i:02d}", texts[i], None) if i % 3 else (f"k{i:02d}", None, [None if v != v else float(v) for v in x[i]] + [9.0]) for i in range(len(x))]
    classes = cut_lineage(nb.vector_classes(spark.createDataFrame(rows, ROWS), names, width))
    index = nb.sample_index(classes, scale, by_mask=True, cell_rows=16)
    got = {tuple(r) for r in nb.near_pairs(nb.member_neighbours(classes, nb.class_neighbours(classes, index, cut_lineage))).collect()}
    want = {(f"k{i:02d}", f"k{i + 30:02d}") for i in range(30) if np.isnan(x[i, -1]) == np.isnan(x[i + 30, -1])}
    assert got == want


def test_an_empty_registry(spark):
    names, scale = nb.coordinates(spark.createDataFrame([], "feature string, variable_name string, vec_pos int, vec_scale double"))
    assert names == {} and len(scale) == 0
    assert nb.vector_classes(spark.createDataFrame([("a", "{}", None)], ROWS), names, 0).count() == 0


def test_latest_fingerprint_counts(spark):
    rows = [("r1", "h1", "{}", 1), ("r1", "h2", '{"x":1}', 2), ("r2", "h1", "{}", 1), ("r2", "h1", "{}", 1), (None, "h", "{}", 1)]
    df = spark.createDataFrame(rows, "request_id string, feature_hash string, features_json string, t int").selectExpr("request_id", "feature_hash", "features_json", "timestamp_seconds(t) AS created_utc")
    assert sorted((r.request_id, r.feature_hash) for r in nb.latest_fingerprints(df, cut_lineage).collect()) == [("r1", "h2"), ("r2", "h1"), ("r2", "h1")]


def test_chi_square_quantiles():
    assert nb.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3) and nb.chi_square_quantile(0.9999, 6) == pytest.approx(27.856, abs=1e-2)
    with pytest.raises(ValueError):
        nb.chi_square_quantile(0.5, 5)


def test_search_without_a_radius_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(0, 0.6, (1500, WIDTH)) * SCALE
    x[rng.random(x.shape) < 0.03] = np.nan
    x = np.concatenate((x, np.repeat(x[50:51], 20, 0)))
    keys = [f"RV-{i}" for i in range(len(x))]
    rows = spark.createDataFrame([(k, None, [None if v != v else float(v) for v in row]) for k, row in zip(keys, x)], ROWS)
    classes = cut_lineage(nb.vector_classes(rows, NAMES, WIDTH, 10))
    index = nb.sample_index(classes, SCALE, by_mask=False, cell_rows=200, projections=nb.KNN_PROJECTIONS)
    near = nb.class_neighbours(classes, index, cut_lineage, 10, float("inf"), nb.KNN_CONFIDENCE, nb.query_classes(10))
    got = {}
    for r in nb.member_neighbours(classes, near, 10).where(nb.in_query_set(nb.F.col("key"))).collect():
        got.setdefault(r.key, []).append(r.d2)
    asked = [i for i in range(len(x)) if i % 50 == 0]
    assert set(got) == {keys[i] for i in asked} and {len(v) for v in got.values()} == {10}
    hits = 0
    for i in asked:
        d = np.sort(np.delete(nb.distances(np.repeat(x[i : i + 1], len(x), 0), x, SCALE), i))[:10]
        hits += sum(v <= d[-1] + 1e-9 for v in got[keys[i]])
    assert hits / (10 * len(asked)) >= 0.9


def test_a_class_of_very_many_copies(spark):
    many = [(f"c{i:06d}", None, [1.0] * WIDTH) for i in range(30_000)] + [("z", None, [1.05] * WIDTH)]
    classes = cut_lineage(nb.vector_classes(spark.createDataFrame(many, ROWS).repartition(6), NAMES, WIDTH))
    heads = classes.where("vec IS NOT NULL").collect()
    assert sorted(len(c.keys) for c in heads) == [1, nb.NEIGHBOURS + 1] and max(heads, key=lambda c: len(c.keys)).keys == [f"c{i:06d}" for i in range(nb.NEIGHBOURS + 1)]
    loose = classes.where("vec IS NULL").selectExpr("explode(keys) AS key")
    assert loose.count() == loose.distinct().count() == 30_000 - nb.NEIGHBOURS - 1
    index = nb.sample_index(classes, SCALE, by_mask=True)
    members = nb.member_neighbours(classes, nb.class_neighbours(classes, index, cut_lineage))
    got = {r.key: r.n for r in members.groupBy("key").agg(nb.F.count("neighbour").alias("n")).where("key IN ('c000000', 'c029999', 'z')").collect()}
    assert got == {"c000000": nb.NEIGHBOURS, "c029999": nb.NEIGHBOURS, "z": nb.NEIGHBOURS}
