"""What the queries on out-of-fold scores send to the driver and to all workers: never their rows.

Spark takes the nine rows made of an order for one when it guesses a table's size, so a join without a
hint may broadcast them all.
"""

import pytest

from riskweave.operators import ranking
from riskweave.plans import core
from riskweave.session import cut_lineage

FOLDER = "/root/testdata/sf0.01"
#: Rows of the fixture there: 15,000 orders, three models, three repeats.
ROWS = 135_000


def _nodes(node):
    yield node
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(node.plan())
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def broadcast_rows(df) -> int:
    """Rows of the largest broadcast of a query that has run."""
    df.collect()
    nodes = [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    return max([0, *(n.metrics().apply("numOutputRows").value() for n in nodes)])


def test_weighted_blend_broadcasts_weights(spark):  # the weights have nine rows, the running totals' buckets 1,024 a ranking
    assert broadcast_rows(core.queries()["blend_perf_weighted"](spark, FOLDER)) <= 9 * 1024


def test_quantile_bins_broadcast_edges(spark):  # nine rows of edges
    assert broadcast_rows(core.queries()["ece_quantile"](spark, FOLDER)) <= 9


def test_percentiles_broadcast_distinct_scores(spark):  # F3
    assert broadcast_rows(core.queries()["label_noise_percentile"](spark, FOLDER)) < ROWS


def test_many_distinct_scores_are_not_broadcast(spark, monkeypatch):  # F3
    monkeypatch.setattr(ranking, "MOST_SCORES", 10)
    rows = spark.createDataFrame([("a", i % 20 / 20, i, 0) for i in range(60)], "k string, score double, row_index int, target int")
    df = ranking.average_rank_percentile(rows, ["k"], cut_lineage)
    assert broadcast_rows(df) <= 20 and "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString()
    assert {(r.row_index, round(r.percentile, 9)) for r in df.collect()} == {(i, round((i % 20 * 3 + 2) / 60 * 100, 9)) for i in range(60)}


def test_label_audit_broadcasts_distinct_scores(spark):  # F8
    assert broadcast_rows(core.queries()["label_noise_audit"](spark, FOLDER)) < ROWS


def test_bands_broadcast_distinct_scores(spark):  # F4
    assert broadcast_rows(core.queries()["percentile_bands"](spark, FOLDER)) < ROWS


@pytest.mark.parametrize("name", ["conformal_sets", "conformal_coverage", "policy_decide", "tier_metrics", "locate_tiers"])  # F7, F12, F5, F6, F9
def test_cuts_are_broadcast(spark, name):  # a few rows a ranking; the buckets of running totals are 1,024 a model, repeat and class
    assert broadcast_rows(core.queries()[name](spark, FOLDER)) <= 18 * 1024
