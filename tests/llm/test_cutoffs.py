"""Cutoffs against brute force, with ties, late rows and batches."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from riskweave.llm import cutoffs
from riskweave.session import cut_lineage

DAY = date(2013, 1, 7)


def brute(scores, target):
    best = None
    for s in sorted(set(scores), reverse=True):
        if sum(x >= s for x in scores) > target:
            break
        best = s
    return best


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [0.0, 1.0, 0.5, 0.5000001, 0.50000011, 0.1] + [round(rng.random(), 6) for _ in range(30)]
    rows = [(i, k, rng.choice(pool)) for k in "abc" for i in range(rng.randrange(1, 60))]
    targets = [(k, rng.randrange(0, 70)) for k in "abcz"]
    df = spark.createDataFrame(rows, "id bigint, k string, score double")
    counts = cutoffs.score_counts(df, ["k"], "score")
    cuts = cutoffs.exact_cutoffs(counts, cutoffs.batch_nodes(counts, ["k"], "score"), spark.createDataFrame(targets, "k string, want int"), ["k"], "score", "want", cut_lineage)
    got = {(r.k, r.id) for r in cutoffs.kept(df, cuts, ["k"], "score").collect()}
    want = set()
    for k, target in targets:
        cut = brute([s for _, kk, s in rows if kk == k], target)
        want |= {(k, i) for i, kk, s in rows if kk == k and cut is not None and s >= cut}
    assert got == want


def test_batches_add_up_and_deletions_count(spark):
    df = spark.createDataFrame([(i, "a", i / 100, date(2013, 1, 1 + i % 3)) for i in range(100)], "id bigint, k string, score double, batch date")
    targets = spark.createDataFrame([("a", 7)], "k string, want int")

    def store(d):
        return cutoffs.batch_nodes(cutoffs.score_counts(d, ["k"], "score"), ["k"], "score")

    def end(tree):
        return [tuple(r) for r in cutoffs.descend_to_targets(tree, targets, ["k"], "want").collect()]

    whole, first = store(df), store(df.where("batch = '2013-01-01'"))
    grown = cutoffs.add_batch(cutoffs.add_batch(first, store(df.where("batch = '2013-01-02'"))), store(df.where("batch = '2013-01-03'")))
    assert end(whole) == end(grown) and end(grown)[0][-1] == 100
    assert end(cutoffs.as_of(grown, F.lit("2013-01-01").cast("date"))) == end(first) and end(first)[0][-1] == 34
    undone = cutoffs.add_batch(grown, store(df.selectExpr("k", "score", "-1 AS n", "date'2013-01-04' AS batch")))
    assert end(undone) == [] and end(cutoffs.as_of(undone, F.lit("2013-01-03").cast("date"))) == end(whole)
    root = {r.batch: r.counts[0] for r in whole.collect()}
    assert sorted(root.values()) == [33, 33, 34] and all(r.nodes[0] == 1 for r in whole.collect())


def test_replaced_rows_leave_in_the_batch_of_their_successor(spark):
    at = lambda d: datetime(2013, 1, d)
    rows = [(1, "r", at(7), "s", DAY, 0.9), (2, "r", at(9), "s", DAY, 0.1), (3, "q", at(7), "s", DAY, 0.5), (4, "q", at(8), "s", DAY, None), (5, "p", at(7), "s", DAY, 0.7)]
    scores = spark.createDataFrame(rows, "id bigint, request_id string, created_utc timestamp, source_name string, screen_date date, calibrated_risk double")
    asked = spark.createDataFrame([(1, "s", DAY, 2)], "capacity_id bigint, source_name string, screen_date date, review_capacity int")
    got = {r.days_after: (r.n_records, r.cutoff, r.n_kept) for r in cutoffs.cutoff_history(cutoffs.scored_rows(scores), asked, cut_lineage, (0, 1, 2)).collect()}
    assert got == {0: (3, 0.7, 2), 1: (2, 0.7, 2), 2: (2, 0.1, 2)}


def test_latest_rows_and_requests(spark):
    at = lambda h: datetime(2013, 1, 7, h)
    rows = [
        (1, "r1", at(1), " Src ", DAY, 0.9), (2, "r1", at(2), "SRC", DAY, 0.2), (3, "r2", at(1), "src", DAY, 0.8), (4, "r2", at(1), "src", DAY, 0.7), (5, "r3", at(1), "src", DAY, float("nan")),
        (6, None, at(1), "src", DAY, 0.6), (7, None, at(1), "src", DAY, 0.6), (8, "r4", None, "src", DAY, 1.5), (9, "r5", at(1), None, DAY, 0.5), (10, "r6", at(3), "src", None, 0.5),
    ]
    scores = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, request_id string, created_utc timestamp, source_name string, screen_date date, calibrated_risk double, __n string")
    rows = cutoffs.scored_rows(scores.withColumnRenamed("__n", "review_capacity"))
    records = cutoffs.latest(rows)
    assert sorted(r.id for r in records.collect()) == [2, 4, 6, 7, 9, 10]
    asked = [(1, "src", DAY, 9, at(1)), (2, "SRC ", DAY, 2, at(2)), (3, "other", DAY, 0, at(1)), (4, "empty", DAY, 5, at(1)), (5, "src", date(2013, 1, 8), None, at(1))]
    capacities = cutoffs.latest_capacities(spark.createDataFrame(asked, "capacity_id bigint, source_name string, screen_date date, review_capacity int, requested_utc timestamp"))
    assert sorted(c.capacity_id for c in capacities.collect()) == [2, 4]
    kept = cutoffs.kept(records, cutoffs.capacity_cutoffs(rows, capacities, cut_lineage), cutoffs.KEYS, "calibrated_risk")
    assert sorted((r.capacity_id, r.id) for r in kept.collect()) == [(2, 4)]  # both 0.6 together would be three
    report = {r.capacity_id: r for r in cutoffs.cutoff_report(cutoffs.scored_rows(scores.withColumnRenamed("__n", "risk_tier"), "risk_tier"), capacities, cut_lineage).collect()}
    assert (report[2].n_records, report[2].n_kept, report[2].cutoff, report[2].tiers) == (4, 1, 0.7, "X") and report[4].n_kept == 0 and report[4].cutoff is None


def test_fraction_and_empty(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None, i / 40) for i in range(40)], "id bigint, k string, score double")
    got = cutoffs.fraction_cutoffs(df, ["k"], "score", 0.25, cut_lineage).collect()
    assert [(r.k, r.target, r.n_records, r.n_kept) for r in got if r.k] == [("a", 5, 20, 5)]
    assert cutoffs.fraction_cutoffs(df.limit(0), ["k"], "score", 0.25, cut_lineage).count() == 0
