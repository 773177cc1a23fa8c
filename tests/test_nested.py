"""Selection, synthetic positives, grades and evidence graphs on inline rows."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import evidence, features, models, nested, similarity


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(400).select(i.alias("row_index"), (i % 10 == 0).cast("int").alias("target"), (F.when(i % 10 == 0, 5.0).otherwise(0.0) + (i * 37 % 11) / 10.0).alias("good"), (i * 53 % 17 / 10.0).alias("noise"), F.when(i % 4 != 0, 1.0).alias("gappy"), (F.floor(i / 10) % 2).cast("int").alias("fold")).cache()  # both folds hold positives


def test_out_of_fold_ranks_the_signal(rows):
    scored = models.out_of_fold(rows, ["good", "noise", "gappy"], models.logistic, folds=2)
    assert scored.count() == 400 and nested._ap(scored) > 0.95
    assert {r.score for r in models.out_of_fold(rows, ["good"], models.prevalence, folds=2).select("score").distinct().collect()} == {0.1}


def test_selection_finds_the_signal(rows):
    freq = {r.feature: r.frequency for r in nested.selection_frequencies(rows, ["good", "noise"], subsamples=2, top=1).collect()}
    assert freq == {"good": 1.0, "noise": 0.0}
    assert [r.feature for r in nested.top_features(nested.selection_frequencies(rows, ["good", "noise"], subsamples=1, top=1), 1, 0.5).collect()] == ["good"]


def test_smote_lies_between_its_parents(rows):
    made = nested.smote(rows, ["good", "noise", "gappy"], 0.2).collect()
    assert len(made) == 72 - 40
    parents = {r.row_index: r for r in rows.collect()}
    for m in made:
        a, b = parents[m.row_index], parents[m.neighbour]
        assert a.target == b.target == 1 and m.row_index != m.neighbour
        assert min(a.good, b.good) - 1e-9 <= m.good <= max(a.good, b.good) + 1e-9
        assert (m.gappy is None) == (a.gappy is None or b.gappy is None)
    assert nested.smote(rows.where("target = 0"), ["good"], 0.2).count() == 0


def test_grades(spark):
    rows = [("a", 0.1, 0.05, 0.95), ("b", 0.2, 0.05, 0.95), ("c", 0.1, None, 0.95), ("d", 0.5, 0.05, 0.95)]
    df = spark.createDataFrame(rows, "model string, relative_drop double, spread double, steady double")
    assert {r.model: r.grade for r in nested.robustness_grades(df).collect()} == {"a": "HIGH", "b": "MEDIUM", "c": "LOW", "d": "LOW"}


def test_smote_bounds_its_parents(spark):
    df = spark.createDataFrame([(i, int(i < 60), float(i), None if i % 7 == 0 else float(-i)) for i in range(600)], "row_index bigint, target int, a double, b double")
    new = nested.smote(df, ["a", "b"], 0.5, most_positives=10).collect()
    assert len(new) == 270 - 60 and len({r.row_index for r in new}) <= 10 and all(r.row_index < 60 and r.neighbour < 60 for r in new)
    assert all(min(r.row_index, r.neighbour) - 1e-9 <= r.a <= max(r.row_index, r.neighbour) + 1e-9 for r in new)


def test_empirical_p(spark):
    drawn = spark.createDataFrame([(i, i / 10) for i in range(9)], "draw int, modal_share double")
    r = nested.empirical_p(drawn, 0.6).first()
    assert (r.n_draws, r.n_as_high, r.p) == (9, 3, 0.4)


def test_isolation_forest_finds_the_odd_row(spark):
    df = spark.range(300).select(F.col("id").alias("row_index"), F.when(F.col("id") == 7, 90.0).otherwise(F.col("id") % 10 / 10.0).alias("a"), (F.col("id") % 7 / 7.0).alias("b"))
    scores = models.isolation_forest(df, ["a", "b"], df, trees=30).orderBy(F.col("anomaly").desc()).collect()
    assert scores[0].row_index == 7 and scores[0].anomaly > scores[1].anomaly
    assert models.isolation_forest(df.limit(0), ["a", "b"], df.limit(0)).count() == 0


def test_platt_keeps_order(rows):
    a, b = models.platt_fit(rows.withColumn("score", F.col("good") / 10))
    assert a > 0 and rows.select(models.platt_apply(F.lit(0.0), a, b).alias("p")).first().p < 0.5


def test_evidence_graph(spark):
    df = spark.createDataFrame([(1, 0.5, [("A", 0.2, True)], [("ood", 0.6)]), (2, 0.1, None, None)], "k int, risk double, reasons array<struct<feature:string,weight:double,raises:boolean>>, doubts array<struct<doubt:string,weight:double>>")
    g = evidence.evidence_graph(df, "k").withColumn("ok", evidence.is_traceable(F.col("nodes"), F.col("edges"))).orderBy("k").collect()
    assert [len(r.nodes) for r in g] == [4, 2] and [len(r.edges) for r in g] == [3, 1] and all(r.ok for r in g)
    broken = evidence.evidence_graph(df, "k").select(evidence.is_traceable(F.slice("nodes", 1, 1), F.col("edges")).alias("ok"))
    assert not any(r.ok for r in broken.collect())


def test_gower_gaps_and_ties(spark):
    import numpy as np

    nan = float("nan")
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [nan, 1.0]), (3, [nan, 2.0]), (4, [0.0, 1.0]), (5, None)], "row bigint, v array<double>")
    got = similarity.topk_in_blocks(df, df.where("row <= 2"), 2, similarity.gower_distance(np.array([0.5, 0.5]), np.array([1.0, 1.0]), 1), block_rows=2).orderBy("query", "rank").collect()
    assert [(r.query, r.row, r.distance) for r in got] == [(1, 4, 0.0), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.5)]


def test_meta_features_without_columns_are_null(spark):
    out = features.with_meta(spark.createDataFrame([(1, "x")], "user_id int, TOT_TXNAMT_DB_L7D string"))
    assert all(out.first()[c] is None for c in out.columns if c.startswith("MG_"))
    filled = features.fill_meta(spark.createDataFrame([(1.0, None)], "TOT_TXNAMT_DB_L7D double, MG_PASSTHROUGH_7D double").withColumn("TOT_TXNAMT_CR_L7D", F.lit(2.0)))
    assert filled.first().MG_PASSTHROUGH_7D == pytest.approx(0.5, abs=1e-5)
