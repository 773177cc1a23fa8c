"""Mixtures of sources: rates, caps, draws and reports."""

import pytest

from riskweave.llm import mixing


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(1000 + i, "b", 10) for i in range(100)] + [(2000, None, 5000), (2001, "c", 0), (2002, "untargeted", 1000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.25, 3), ("b", 0.2, 2), ("c", 0.0, 4), ("missing", 0.3, 5), ("d", None, None)], "source_name string, target_weight double, max_repeats int")


def test_rates_and_caps(sized, targets):
    rates = {r.source_name: r for r in mixing.mixing_rates(mixing.source_tokens(sized), targets).collect()}
    total = 10_000 + 1000 + 5000 + 1000
    assert rates["a"].total_tokens == total and rates["a"].rate == pytest.approx(0.25 * total / 10_000) and not rates["a"].is_capped
    assert rates["b"].is_capped and rates["b"].rate == 2.0
    assert not rates["c"].is_capped and rates["c"].rate == 0.0
    assert rates["missing"].is_capped and rates["missing"].rate == 0.0
    assert not rates["d"].is_capped


def test_draw_is_repeatable_and_capped(sized, targets):
    rates = mixing.mixing_rates(mixing.source_tokens(sized), targets)
    drawn = mixing.draw_copies(sized, rates)
    again = mixing.draw_copies(sized.repartition(7), rates)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.emit_copies(drawn).groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    report = {r.source_name: r for r in mixing.mixture_report(drawn, rates).collect()}
    assert abs(report["a"].emitted_tokens - 0.25 * 17_000) < 600 and report["b"].most_copies == 2
    assert report["missing"].emitted_docs == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-5)


def test_empty_corpus(sized, targets):
    rates = mixing.mixing_rates(mixing.source_tokens(sized.limit(0)), targets)
    assert {r.rate for r in rates.collect()} == {0.0} and rates.where("is_capped").count() == 0
    report = mixing.mixture_report(mixing.draw_copies(sized.limit(0), rates), rates).collect()
    assert len(report) == 5 and {r.actual_share for r in report} == {0.0}
