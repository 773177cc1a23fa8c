"""Fits of many groups, calibrator choice, Shapley values and counterfactuals against plain versions."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import ensembles, explain, governance, resampling, splits
from riskweave.session import cut_lineage, release, shared_checkpoint_dir


def newton(x, y, c, ridge):
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        f = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (c * f * (1 - f))[:, None]).T @ x + penalty, x.T @ (c * (y - f)) - penalty @ w)
    return w


@pytest.mark.parametrize("balanced", [False, True])
def test_fits_of_many_groups_are_those_of_each(spark, balanced):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", None, "b"):
        for _ in range(200):
            x = rng.normal(0, 1, 2)
            rows.append((g, int(rng.random() < 1 / (1 + math.exp(2 - x[0] * 1.5 + x[1]))), float(x[0]), float(x[1])))
    rows += [("one class", 1, 0.5, 0.5), ("a", 1, None, 0.0)]
    df = spark.createDataFrame(rows, "g string, target int, u double, v double")
    got = {r.g: r.w for r in ensembles.fit_logistics(df, ["g"], ["u", "v"], 1.0, balanced).collect()}
    assert set(got) == {"a", None, "b"}
    for g, w in got.items():
        own = [r for r in rows if r[0] == g and r[2] is not None]
        y = np.array([r[1] for r in own], float)
        c = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum()) if balanced else np.ones(len(y))
        assert w == pytest.approx(newton(np.array([r[2:] for r in own]), y, c, 1.0), abs=1e-6)


def test_out_of_fold_predictions_use_the_other_folds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, int(rng.random() < 0.3), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "row_index int, fold int, target int, u double").withColumn("k", F.lit(1))
    got = {r.row_index: r.stacked for r in ensembles.out_of_fold_logistics(df, ["k"], ["u"], 3, balanced=False).collect()}
    for held in range(3):
        own = [r for r in rows if r[1] != held]
        w = newton(np.array([[r[3]] for r in own]), np.array([r[2] for r in own], float), np.ones(len(own)), 1.0)
        for r in rows:
            if r[1] == held:
                assert got[r[0]] == pytest.approx(1 / (1 + math.exp(-w[0] - w[1] * r[3])), abs=1e-6)


def test_counted_rows_give_the_fits_and_metrics_of_all(spark):
    from riskweave.operators import models, ranking

    rng = np.random.default_rng(6)
    rows = [("a", i % 3, int(rng.random() < 0.1 + 0.06 * s), s / 10) for i, s in enumerate(rng.integers(0, 10, 300).tolist())]
    every = spark.createDataFrame(rows, "k string, fold int, target int, score double")
    counted = every.groupBy("k", "fold", "target", "score").agg(F.count(F.lit(1)).alias("n"))
    one = lambda df: [v for r in df.orderBy(*df.columns[:2]).collect() for v in r[1:]]
    assert one(ensembles.platt_fits(counted, ["k"], weight="n", settle=cut_lineage)) == pytest.approx(one(ensembles.platt_fits(every, ["k"])), abs=1e-9)
    assert one(ranking.probability_quality(counted, ["k"], weight="n")) == pytest.approx(one(ranking.probability_quality(every, ["k"])), abs=1e-12)
    edges = [0.0, 0.35, 0.65, 1.0]
    assert one(ranking.binned_calibration(counted, ["k"], edges, weight="n")) == pytest.approx(one(ranking.binned_calibration(every, ["k"], edges)), abs=1e-12)
    fits = [{(r.fold, r.score): r.calibrated for r in models.cross_fitted(df, "isotonic", folds=3, weight=w).collect()} for df, w in ((every, None), (counted, "n"))]
    assert fits[0] == pytest.approx(fits[1], abs=1e-12)


def test_isotonic_only_if_both_improve(spark):
    rows = [("a", "platt", 0.10, 0.10), ("a", "isotonic", 0.09, 0.09), ("b", "platt", 0.10, 0.10), ("b", "isotonic", 0.05, 0.099), ("c", "platt", 0.1, 0.1), ("d", "platt", 0.0, 0.1), ("d", "isotonic", 0.0, 0.01)]
    df = spark.createDataFrame(rows, "model string, method string, brier double, ece double")
    assert {r.model: r.chosen for r in ensembles.choose_calibrator(df, ["model"]).collect()} == {"a": "isotonic", "b": "platt", "c": "platt", "d": "platt"}


TREE = (0, 0.5, (1, 2.0, (1.0, 30.0), (5.0, 10.0), 40.0), (2, 0.0, (-2.0, 25.0), (0, 3.0, (7.0, 20.0), (9.0, 15.0), 35.0), 60.0), 100.0)


def test_shapley_values_are_averages_over_orders():
    rng = np.random.default_rng(0)
    x = rng.normal(1, 2, (20, 4))
    got, base = explain.shapley_of_trees([(0.5, TREE), (2.0, (3, 0.0, (1.0, 5.0), (2.0, 5.0), 10.0)), (1.0, (4.0, 10.0))], x)
    value = lambda known: 0.5 * explain._expected(TREE, x, known) + 2 * explain._expected((3, 0.0, (1.0, 5.0), (2.0, 5.0), 10.0), x, known) + 4.0
    want = np.zeros_like(x)
    for order in permutations(range(4)):
        for i, f in enumerate(order):
            want[:, f] += (value(frozenset(order[: i + 1])) - value(frozenset(order[:i]))) / 24
    assert np.allclose(got, want) and np.allclose(base + got.sum(1), value(frozenset(range(4)))) and base == pytest.approx(value(frozenset())[0])
    assert explain.shapley_of_trees([(1.0, TREE)], x[:0])[0].shape == (0, 4)


def test_counterfactuals(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, "clash"), (2, None, -1.0, None), (3, 0.0, 0.0, None)], "row_index int, a double, b double, score string")
    got = [tuple(r) for r in explain.counterfactuals(df, {"a": 1.0, "b": 2.0}, -1.0, {"a": 0.5, "b": 0.0}, 0.4).orderBy("row_index", "step").collect()]
    s = lambda z: 1 / (1 + math.exp(-z))
    want = [(1, 0, None, s(4)), (1, 1, "a", s(1.5)), (1, 2, "b", s(-0.5)), (2, 0, None, s(-2.5)), (3, 0, None, s(-1))]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want]) and [g[4] for g in got] == [False, False, True, True, True]


def test_global_importance(spark):
    df = spark.createDataFrame([(1, "a", -3.0), (1, "b", 1.0), (2, "a", 3.0), (2, "b", 0.0)], "row_index int, feature string, contribution double")
    got = {r.feature: (r.mean_abs, r.place) for r in explain.global_importance(df).collect()}
    assert got == {"a": (3.0, 1), "b": (0.5, 2)}


def test_a_run_that_may_happen_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for attempt in (1, 2, 3):
        rows = governance.touch_once(spark, str(tmp_path / "once"), "report", build).orderBy("attempt").collect()
        assert [(r.attempt, r.is_refused) for r in rows] == [(i, i > 1) for i in range(1, attempt + 1)]
    assert built == [1]


def test_narratives(spark):
    texts = ['{"text": "Guilty of 12 and 3.5"}', "{}", "", None, '{"text": null}', '{"text": "3.5 only"}', "[1", '{"text": "confirmed MULE"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.f for r in df.orderBy("i").select(governance.narrative_faults(F.col("t"), F.array(F.lit("3.5"))).alias("f")).collect()]
    assert got == [["NUMBER:12", "PHRASE:guilty"], ["NO_TEXT"], ["NOT_JSON"], ["NOT_JSON"], ["NO_TEXT"], [], ["NOT_JSON"], ["PHRASE:confirmed mule"]]


def test_statistics_as_columns(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (3, 9), (1, 1)], "u bigint, d bigint")
    for r in df.withColumn("p", resampling.sign_test_column(F.col("u"), F.col("d"))).collect():
        assert r.p == pytest.approx(resampling.sign_test(r.u, r.d))
    assert resampling.t_critical(2) == pytest.approx(4.302652729696142) and resampling.t_critical(30) == pytest.approx(2.0422724563, rel=1e-6)


def test_orders_of_two_seeds_are_unrelated(spark):
    rows = spark.range(20_000).select(*(splits.shuffle_hash(F.col("id"), s).alias(f"h{s}") for s in (1, 2))).toPandas()
    assert abs(rows.h1.corr(rows.h2)) < 0.03 and rows.h1.nunique() > 19_980 and abs((rows.h1 < splits.MODULUS / 2).mean() - 0.5) < 0.02
    gaps = rows.h1.diff().dropna().abs() / splits.MODULUS
    assert abs(gaps.mean() - 1 / 3) < 0.02  # neighbours in key are not neighbours in order


def test_released_tables_are_gone(spark):
    stored = cut_lineage(spark.range(5))
    folder = stored._riskweave_folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path) and shared_checkpoint_dir(spark) in folder
    release(stored, stored, spark.range(1), None)
    assert not fs.exists(path)
