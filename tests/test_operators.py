"""Core operators on inline rows: ties, nulls, single classes, empty inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import canonical, capacity, decisions, graph, profiling, ranking, resampling, splits, store
from riskweave.operators.quantiles import linear_quantiles, running_counts, value_counts
from riskweave.session import cut_lineage


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index bigint, target int, score double")


def test_ap_and_roc_with_ties(spark):
    m = ranking.average_precision_roc(ranking.ranked_points(scored(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, None)]), []), []).first()
    assert (m.n_rows, m.n_pos) == (4, 2)
    assert m.ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and m.roc_auc == pytest.approx(0.875)


@pytest.mark.parametrize("rows", [[(0, 0.5), (0, 0.2)], [(1, 0.5)], []])
def test_one_class_has_no_ap(spark, rows):
    m = ranking.average_precision_roc(ranking.ranked_points(scored(spark, rows), []), []).collect()
    assert all(r.ap is None and r.roc_auc is None for r in m)


def test_scores_outside_the_buckets_stay_exact(spark):
    rows = [(1, 7.5), (0, 7.25), (1, -3.0), (0, -3.5), (1, 1e9)]
    ranked = ranking.ranked_rows(scored(spark, rows), []).select("row_index", "rn").collect()
    assert {r.row_index: r.rn for r in ranked} == {4: 1, 0: 2, 1: 3, 2: 4, 3: 5}


def test_ranks_break_ties_by_row(spark):
    ranked = ranking.ranked_rows(scored(spark, [(0, 0.5)] * 5), []).collect()
    assert {r.row_index: r.rn for r in ranked} == {i: i + 1 for i in range(5)}


def test_quantiles_match_linear_interpolation(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 10, -4)] + [("b", None), ("b", float("nan")), ("c", 3.0)]
    counts = value_counts(spark.createDataFrame(rows, "k string, value double"), ["k"])
    got = {r.k: (r.lo, r.mid, r.hi) for r in linear_quantiles(counts, ["k"], {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    assert got["a"] == pytest.approx((-2.0, 2.0, 6.8)) and got["c"] == (3.0, 3.0, 3.0) and "b" not in got
    assert running_counts(counts, ["k"]).where("k = 'a' AND value = 2").first().cum_n == 4


def test_confusion_has_nulls_for_empty_denominators(spark):
    m = ranking.confusion_metrics(ranking.confusion(scored(spark, [(0, 0.1), (0, 0.2)]), [], 0.5)).first()
    assert m.precision is None and m.recall is None and m.specificity == 1.0 and m.mcc is None


def test_capacity_between_and_below_measured_budgets(spark):
    rows = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]).withColumn("k", F.lit(1))
    curve = capacity.capacity_curve(ranking.ranked_rows(rows, ["k"]), ranking.ranked_points(rows, ["k"]), ["k"], capacity.budget_grid(spark, 4))
    got = {r.budget: (r.true_positives, r.n_alerts_at_threshold) for r in curve.collect()}
    assert got == {1: (1, 1), 2: (1, 3), 3: (2, 3), 4: (2, 4)}
    assert capacity.plan_for_budget(curve, ["k"], 99).first().budget == 4
    assert capacity.plan_for_fp(curve, ["k"], 0.0).first().budget == 1


def test_conformal_empty_class_is_one(spark):
    q = decisions.conformal_quantiles(scored(spark, [(0, 0.1), (0, 0.3)]), []).first()
    assert q.q_pos == 1.0 and q.q_neg == 0.3


def test_policy_precedence(spark):
    rows = [(0.95, "UNCERTAIN_SET", "IN_DISTRIBUTION", None, False), (0.95, "HIGH_RISK_SET", "IN_DISTRIBUTION", None, False), (0.01, "LOW_RISK_SET", "IN_DISTRIBUTION", 99.0, None), (0.01, "LOW_RISK_SET", "OUT_OF_DISTRIBUTION", None, True), (0.01, "LOW_RISK_SET", "IN_DISTRIBUTION", None, None)]
    df = spark.createDataFrame(rows, "risk double, c string, o string, a double, v boolean")
    tier = decisions.risk_tier(F.col("risk"), F.lit(0.9), F.lit(0.5), F.lit(0.2), F.col("c"), F.col("o"), F.col("a"), F.col("v"))
    assert [r[0] for r in df.select(tier).collect()] == ["URGENT_REVIEW", "CRITICAL_REVIEW", "STANDARD_REVIEW", "OOD_REVIEW", "MONITOR"]


def edges(spark, rows):
    return graph.clean_edges(spark.createDataFrame(rows, "account_from string, account_to string, amount double, timestamp string"))


def test_graph_cleaning_and_components(spark):
    raw = spark.createDataFrame([("a", "b", 1.0, "2026-01-01 00:00:00"), ("b", "a", 1.0, "bad"), ("a", "a", 0.0, None), ("c", "d", 0.0, None), ("d", "e", 2.0, None), (None, "a", 1.0, None)], "account_from string, account_to string, amount double, timestamp string")
    assert tuple(graph.edge_report(raw).first()) == (6, 1, 1, 3, 2)
    clean = graph.clean_edges(raw)
    assert {tuple(r) for r in graph.weak_components(clean, cut_lineage).collect()} == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")}
    assert {tuple(r) for r in graph.strong_components(clean, cut_lineage).collect()} == {("a", "b"), ("b", "b"), ("d", "d"), ("e", "e")}


def test_graph_path_component_needs_few_rounds(spark):
    chain = edges(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 1.0, None) for i in range(60)])
    assert graph.weak_components(chain, cut_lineage).select("component").distinct().count() == 1


def test_dwell_reaches_over_days_and_reuses_outflows(spark):
    e = edges(spark, [("x", "a", 1.0, "2026-01-01 10:00:00"), ("y", "a", 1.0, "2026-01-01 12:00:00"), ("a", "z", 1.0, "2026-01-04 12:00:00"), ("z", "a", 1.0, "2026-01-05 00:00:00")])
    got = graph.dwell_medians(e).where("account = 'a'").first()
    assert (got.n_matched, got.median_dwell_hours) == (2, 74.0)


def test_velocity_window_is_inclusive(spark):
    e = edges(spark, [("x", "a", 1.0, f"2026-01-0{d} 00:00:00") for d in (1, 2, 4, 8)])
    got = graph.velocity(e).where("account = 'a'").first()
    assert (got.n_stamps, got.busiest, got.status) == (4, 2, "BURST")  # 2 against 4 stamps in 7 days


def test_cycles_and_chains(spark):
    e = edges(spark, [("a", "b", 1.0, "2026-01-01 00:00:00"), ("b", "c", 1.0, "2026-01-01 05:00:00"), ("c", "a", 1.0, "2026-01-09 00:00:00")])
    seeds = spark.createDataFrame([("a",), ("zz",)], "a string")
    assert [tuple(r) for r in graph.shortest_cycles(e, seeds, cut_lineage).collect()] == [("a", 3)]
    assert {r.account: r.depth for r in graph.rapid_chains(e, cut_lineage).collect()} == {"a": 2, "b": 1, "c": 1}


def _cycle_truth(pairs, most):
    out = {}
    for seed in {a for p in pairs for a in p}:
        front, seen = {seed}, set()
        for hop in range(1, most + 1):
            front = {b for a, b in pairs if a in front} - seen
            if seed in front:
                out[seed] = hop
                break
            seen |= front
    return out


def test_cycles_of_every_account(spark):
    rings = {(f"r{n}_{i}", f"r{n}_{(i + 1) % n}") for n in range(2, 9) for i in range(n)}
    loose = {("r2_0", "r7_0"), ("r7_0", "tail"), ("r8_1", "r8_5"), ("r4_0", "r6_3"), ("r6_5", "r4_2")}
    mixed = {(f"m{i}", f"m{(i * 7 + k * k + 1) % 40}") for i in range(40) for k in range(i % 3)}
    pairs = {(a, b) for a, b in rings | loose | mixed if a != b}
    e = edges(spark, [(a, b, 1.0, None) for a, b in sorted(pairs)])
    rows = graph.cycle_lengths(e, cut_lineage).collect()
    assert len(rows) == len({r.account for r in rows}) and {r.account: r.length for r in rows} == _cycle_truth(pairs, 6)


def test_cycles_of_seeds_stop_where_they_are_found(spark):
    tree = {("s", f"t{i}") for i in range(8)} | {(f"t{i}", f"t{i}{j}") for i in range(8) for j in range(8)} | {(f"t{i}{j}", f"t{i}{j}{k}") for i in range(8) for j in range(8) for k in range(8)}
    mixed = {(f"m{i}", f"m{(i * 7 + k * k + 1) % 40}") for i in range(40) for k in range(i % 3)}
    pairs = {(a, b) for a, b in tree | {("s", "u"), ("u", "s")} | mixed if a != b}
    e, written = edges(spark, [(a, b, 1.0, None) for a, b in sorted(pairs)]), []

    def settle(df):
        out = cut_lineage(df)
        written.append(out.count())
        return out

    asked = ["s", "zz", *(f"m{i}" for i in range(0, 40, 5))]
    got = [tuple(r) for r in graph.shortest_cycles(e, spark.createDataFrame([(a,) for a in asked], "a string"), settle).collect()]
    assert sorted(got) == sorted((a, n) for a, n in _cycle_truth(pairs, 6).items() if a in asked)
    assert max(written[1:]) < 120  # the links come first; the tree has 584 accounts


def test_patterns_name_circular_flow(spark):
    from riskweave.plans import core
    from tests.helpers.compare import SMALL

    e = edges(spark, [("a", "b", 1.0, None), ("b", "c", 1.0, None), ("c", "a", 1.0, None), ("c", "d", 1.0, None)])
    got = graph.structures(graph.account_metrics(e), graph.dwell_medians(e), graph.rapid_chains(e, cut_lineage, 3), graph.cycle_lengths(e, cut_lineage))
    assert {r.account: r.patterns for r in got.collect()} == {"a": "CIRCULAR_FLOW", "b": "CIRCULAR_FLOW", "c": "CIRCULAR_FLOW", "d": ""}
    four = {r.account: r.patterns for r in core.queries()["graph_patterns"](spark, SMALL).collect()}
    assert {r.account: r.patterns.replace(",CIRCULAR_FLOW", "") for r in core.queries()["graph_patterns_all"](spark, SMALL).where("patterns LIKE '%CIRCULAR_FLOW'").collect()} == four


def test_chains_of_every_depth_to_eight(spark):
    from riskweave.plans import core
    from tests.helpers.compare import SMALL

    hops = [(f"n{i:02d}", f"n{i + 1:02d}", 5 * i) for i in range(11)] + [("n03", "n08", 0), ("m0", "n06", 7), ("n09", "q", 200)]
    e = edges(spark, [(a, b, 1.0, f"2026-01-{1 + h // 24:02d} {h % 24:02d}:00:00") for a, b, h in hops])

    def longest(node, t, left):
        return max((1 + longest(b, h, left - 1) for a, b, h in hops if left and a == node and (t is None or 0 <= h - t <= 24)), default=0)

    truth = {a: longest(a, None, 8) for a, _, _ in hops}
    assert set(truth.values()) == set(range(1, 9))
    assert {r.account: r.depth for r in graph.rapid_chains(e, cut_lineage).collect()} == truth
    assert core.queries()["rapid_chains_eight"](spark, SMALL).where("depth > 4").count() > 0


def test_edge_headers_by_alias(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "Sender string, RECEIVER string, Value double")
    assert graph.edge_columns(df).columns == ["account_from", "account_to", "amount", "timestamp"]
    with pytest.raises(ValueError):
        graph.edge_columns(df.drop("Value"))


def test_profile_of_constant_null_and_negative_zero(spark):
    df = spark.createDataFrame([(1, 0.0, None, -0.0), (2, 0.0, None, 0.0)], "row_index bigint, a double, b double, c double")
    p = {r.feature: r for r in profiling.profile_columns(df, ["a", "b", "c"], cut_lineage).collect()}
    assert p["a"].is_constant and p["a"].zero_rate == 1.0 and p["b"].n_unique == 0 and p["b"].is_quasi_constant
    assert {r.feature: r.duplicate_of for r in profiling.duplicate_columns(df, ["a", "b", "c"], "row_index").collect()} == {"a": None, "b": None, "c": "a"}


def test_profile_in_pieces_is_the_same(spark, monkeypatch):
    rng = random.Random(3)
    pool = [0.0, -0.0, 1.5, -2.0, 1e300, -1e-300, float("nan"), None, 7.0]
    rows = [(rng.gauss(0, 1000), rng.choice(pool), float(i % 50), None if i % 9 else 3.25) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, `c d` double, e double").repartition(5)
    profile = lambda: {tuple(round(v, 9) if isinstance(v, float) and abs(v) < 1e9 else v for v in r) for r in profiling.profile_columns(df, df.columns, cut_lineage).collect()}
    whole = profile()
    monkeypatch.setattr(profiling, "WHOLE_ROWS", 10)
    assert profile() == whole
    a = sorted(r[0] for r in rows)
    row = next(r for r in whole if r[0] == "a")
    assert row[1] == 3000 and row[4] == 3000 and row[10] == round(a[0], 9) and row[11] == round(a[-1], 9) and row[16] == pytest.approx((a[1499] + a[1500]) / 2)
    assert profiling.profile_columns(df.limit(0), ["a"], cut_lineage).count() == 0


@pytest.mark.parametrize("gap", [0.0, 0.3])
def test_single_feature_scores_are_those_of_each_fold(spark, gap, monkeypatch):
    rng = random.Random(int(gap * 10))
    rows = [(i % 3, int(rng.random() < 0.2), None if rng.random() < gap else rng.choice([rng.gauss(5, 9), 4.0, -1.0])) for i in range(240)]
    df = spark.createDataFrame([("x", *r) for r in rows] + [("none", i % 3, int(i % 4 == 0), None) for i in range(24)], "feature string, fold int, target int, value double")

    def figures(points):
        ap = roc = cp = cq = 0
        for s in sorted({s for s, _ in points}, reverse=True):
            p = sum(t for v, t in points if v == s)
            q = sum(1 - t for v, t in points if v == s)
            roc += q * (cp + p / 2)
            cp, cq = cp + p, cq + q
            ap += p * cp / (cp + cq)
        return ap / cp, roc / (cp * cq)

    want = []
    for held in range(3):
        known = sorted(v for f, _, v in rows if f != held and v is not None)
        median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
        side = lambda keep, sign: figures([(sign * (median if v is None else v), t) for f, t, v in rows if (f == held) == keep])  # noqa: E731, B023
        sign = 1 if side(False, 1)[0] >= side(False, -1)[0] else -1
        want.append(side(True, sign))
    got = {r.feature: r for r in profiling.single_feature_scores(df, 3).collect()}
    assert (got["x"].ap, got["x"].auc) == pytest.approx((sum(w[0] for w in want) / 3, sum(w[1] for w in want) / 3))
    assert got["none"].auc == pytest.approx(0.5)
    table = df.where("feature = 'x'").selectExpr("fold", "target", "value AS `a b`", "CAST(NULL AS DOUBLE) AS none", "CAST(value AS STRING) AS text")
    for most in (2_000_000, 10):
        monkeypatch.setattr(profiling, "WHOLE_ROWS", most)
        wide = {r.feature: (r.ap, r.auc) for r in profiling.column_scores(table, ["a b", "none", "text"], 3).collect()}
        assert wide["a b"] == wide["text"] == pytest.approx((got["x"].ap, got["x"].auc)) and wide["none"][1] == pytest.approx(0.5)


def test_holdout_never_splits_a_group(spark):
    rows = spark.createDataFrame([(i, i % 7, int(i % 21 == 0)) for i in range(210)], "row_index bigint, grp bigint, target int")
    h = splits.holdout(rows, "grp", "target", 0.3, 1)
    assert h.count() == 7 and 0 < h.where("is_test").count() < 7


def test_statistics():
    assert resampling.sign_test(0, 0) == 1.0 and resampling.sign_test(5, 0) == pytest.approx(0.0625)
    assert resampling.t_test(1.0, 1.0, 10) == pytest.approx(0.011507985, rel=1e-5)
    assert resampling.wilcoxon([1, 2, 3, 4, 5]) == pytest.approx(0.0625) and resampling.wilcoxon([0, 0]) == 1.0
    assert resampling.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert math.isclose(resampling.t_test(0.0, 1.0, 5), 1.0)


def test_canonical_edge_cases(spark):
    df = spark.createDataFrame([(" NA ", "1", None), ("2", "x", None)], "a string, b string, c string")
    assert {r["column"]: r["kind"] for r in canonical.column_report(df).collect()} == {"a": "number", "b": "category", "c": "number"}
    assert canonical.canonicalise(df.limit(0)).count() == 0
    assert canonical.schema_integrity(df, ["a", "b", "c"], ["b"]).first().status == "WARN"


def test_store(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (2, 1, None)], "k int, v int, s double")
    assert {(r.k, r.v) for r in store.latest(df, ["k"], F.col("v").desc()).collect()} == {(1, 2), (2, 1)}
    same = df.where("k = 1 AND v = 1").withColumn("t", F.lit("x"))
    assert store.snapshot_diff(same, same, "k", "s", "t").first().verdict == "PASS"
    assert store.snapshot_diff(same, same.limit(0), "k", "s", "t").first().n_lost == 1
    assert store.impact(spark.createDataFrame([(5, 2, 1)], "budget bigint, true_positives bigint, missed bigint"), 0, 1, 1, 1).count() == 0
