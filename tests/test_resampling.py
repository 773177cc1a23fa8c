"""Bootstrap replicates against the same draws worked out plainly, and their distribution."""

import numpy as np
import pytest

from riskweave.operators import resampling as rs
from riskweave.session import cut_lineage


def metrics(pos, neg, budgets):
    """Plain metrics of weighted points, highest score first: (ap, roc_auc, hits at budgets)."""
    ap = roc = cp = cn = 0.0
    for p, n in zip(pos, neg):
        roc += n * (cp + p / 2)
        cp, cn = cp + p, cn + n
        ap += p * cp / (cp + cn) if cp + cn else 0
    tp = []
    for budget in budgets:
        room, got = budget, 0.0
        for p, n in zip(pos, neg):
            take = min(room, p + n)
            got += p * take / (p + n) if p + n else 0
            room -= take
        tp.append(got)
    return ap / cp, roc / (cp * cn), tp


def rows_of(seed, n=400):
    rng = np.random.default_rng(seed)
    score = np.round(rng.random(n), 2 + seed)
    return [("k", i, float(s), int(rng.random() < s**3)) for i, s in enumerate(score)] + [(None, n + i, i / 40, int(i % 3 == 0)) for i in range(40)] + [("k", None, None, 1), ("one", 0, 0.5, 1)]


@pytest.mark.parametrize("seed", [0, 1])
def test_replicate_zero_is_the_sample(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "k string, row_index int, score double, target int")
    got = {(r.k, r.scheme): r for r in rs.replicate_metrics(df, ["k"], cut_lineage, 3, (5, 30, 10_000)).where("replicate = 0").collect()}
    assert len(got) == 6 and got["one", "stratified"].ap is None
    for key in ("k", None):
        own = [r for r in rows if r[0] == key and r[2] is not None]
        scores = sorted({r[2] for r in own}, reverse=True)
        ap, roc, tp = metrics([sum(r[3] for r in own if r[2] == s) for s in scores], [sum(1 - r[3] for r in own if r[2] == s) for s in scores], (5, 30, 10_000))
        for scheme in rs.SCHEMES:
            r = got[key, scheme]
            assert (r.ap, r.roc_auc, r.tp_5, r.tp_30, r.tp_10000) == pytest.approx((ap, roc, *tp))


def test_replicates_are_the_metrics_of_their_draws(spark, monkeypatch):
    rows = [r for r in rows_of(2) if r[0] == "k" and r[2] is not None]
    df = spark.createDataFrame(rows, "k string, row_index int, score double, target int")
    got = {(r.replicate, r.scheme): r for r in rs.replicate_metrics(df, ["k"], cut_lineage, 260, (30,)).collect()}
    assert len(got) == 2 * 261
    points = df.where("score IS NOT NULL").groupBy("k", "score").agg(rs.F.count_if(rs.F.col("target") == 1).alias("p"), rs.F.count_if(rs.F.col("target") == 0).alias("q"))
    hashed = points.select("score", "p", "q", *(rs.F.xxhash64(rs.F.lit(42), "k", "score", rs.F.lit(c)).alias(f"h{c}") for c in "pq")).orderBy(rs.F.col("score").desc()).toPandas()
    for block in (np.arange(0, 250), np.arange(250, 261)):
        wp, wq = (rs.poisson_weights(hashed[c].to_numpy(), hashed[f"h{c}"].to_numpy(), block) for c in "pq")
        for j in (0, 3, 10):
            r, s = got[int(block[j]), "resample_accounts"], got[int(block[j]), "stratified"]
            ap, roc, tp = metrics(wp[:, j], wq[:, j], (30,))
            assert (r.ap, r.roc_auc, r.tp_30, r.n_pos) == pytest.approx((ap, roc, tp[0], wp[:, j].sum()))
            a, b = hashed.p.sum() / wp[:, j].sum(), hashed.q.sum() / wq[:, j].sum()
            ap, roc, tp = metrics(wp[:, j] * a, wq[:, j] * b, (30,))
            assert (s.ap, s.roc_auc, s.tp_30, s.n_pos) == pytest.approx((ap, roc, tp[0], hashed.p.sum()))


def test_weights_are_poisson_and_independent():
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    for n in (1, 4):
        w = rs.poisson_weights(np.full(3000, n), h, np.arange(1, 41))
        assert abs(w.mean() - n) < 0.02 * n and abs(w.var() - n) < 0.05 * n
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.6
    assert (rs.poisson_weights(np.array([0, 3]), h[:2], np.arange(0, 3))[:, 0] == [0, 3]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "k string, score double, target int")
    assert rs.replicate_metrics(df, ["k"], cut_lineage, 5).count() == 0
