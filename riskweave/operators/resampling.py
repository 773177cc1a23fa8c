"""Bootstrap intervals and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_runs import run_slices
from .ranking import BUDGETS

#: Cumulative probabilities of a Poisson variable with mean 1 (fixed values).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


#: Schemes of drawing (fixed values).
SCHEMES = ("resample_accounts", "stratified")
#: Replicates of an interval (fixed value), how many of them a task draws at a time, and pieces of a ranking.
REPLICATES, BLOCK, PIECES_OF_SCORE = 2000, 250, 128
#: Rows of a slice whose weights are drawn at once: BLOCK weights of 8 bytes each.
SLICE_ROWS = 4000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(rows, replicates) numbers of 0..1 from 64-bit hashes by a counter-based generator."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(1))[None, :] * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def poisson_weights(n: np.ndarray, h: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each replicate draws n equal rows: Poisson with mean n, by the rows' hash; replicate 0 is the sample itself."""
    out = np.zeros((len(n), len(replicates)), np.int64)
    one = n == 1
    if one.any():
        out[one] = np.searchsorted(POISSON, _uniform(h[one], replicates), "right")
    for i in np.nonzero(n > 1)[0]:
        key = (int(h[i]) & ((1 << 64) - 1)) | int(replicates[0]) << 64
        out[i] = np.random.Generator(np.random.Philox(key=key)).poisson(n[i], len(replicates))
    if replicates[0] == 0:
        out[:, 0] = n
    return out


class _Sums:
    """Running sums of the replicates of one block through one piece of a ranking, from the highest score down."""

    def __init__(self, replicates: np.ndarray, budgets: tuple[int, ...], pos=None, neg=None, all_pos=None, all_neg=None, n_pos: float = 0, n_neg: float = 0):
        size = len(replicates)
        self.replicates, self.budgets = replicates, budgets
        self.pos, self.neg = (np.zeros(size) if x is None else np.asarray(x, float).copy() for x in (pos, neg))
        self.roc, self.ap, self.tp = np.zeros(size), np.zeros((2, size)), np.zeros((2, len(budgets), size))
        with np.errstate(divide="ignore", invalid="ignore"):
            # the stratified scheme keeps the sample's numbers of both classes
            self.scale = [(np.ones(size), np.ones(size))] if all_pos is None else [(np.ones(size), np.ones(size)), (np.nan_to_num(n_pos / np.asarray(all_pos, float), posinf=0.0), np.nan_to_num(n_neg / np.asarray(all_neg, float), posinf=0.0))]

    def feed(self, rows: pa.RecordBatch, measure: bool) -> None:
        p, q, hp, hq = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q", "hp", "hq"))
        for at in range(0, len(p), SLICE_ROWS):
            cut = slice(at, at + SLICE_ROWS)
            wp, wq = poisson_weights(p[cut], hp[cut], self.replicates), poisson_weights(q[cut], hq[cut], self.replicates)
            if measure:
                self._measure(wp, wq)
            self.pos += wp.sum(0)
            self.neg += wq.sum(0)

    def _measure(self, wp: np.ndarray, wq: np.ndarray) -> None:
        cp, cq = self.pos + wp.cumsum(0), self.neg + wq.cumsum(0)
        self.roc += (wq * (cp - wp / 2)).sum(0)
        for k, (a, b) in enumerate(self.scale):
            above = a * cp + b * cq
            self.ap[k] += (a * wp * np.divide(a * cp, above, out=np.zeros_like(above), where=above > 0)).sum(0)
            own = a * wp + b * wq
            if self.budgets and (a * self.pos + b * self.neg).min() >= max(self.budgets):
                continue
            for i, budget in enumerate(self.budgets):
                inside = (own > 0) & (above >= budget) & (above - own < budget)
                if inside.any():
                    taken = np.divide(budget - (above - own), own, out=np.zeros_like(own), where=inside)
                    self.tp[k, i] += np.where(inside, a * (cp - wp) + taken * a * wp, 0.0).sum(0)


def _struct(fields: str) -> str:
    return ", ".join(f"{f} array<double>" for f in fields.split())


def replicate_metrics(rows: DataFrame, keys: list[str], settle, n: int = REPLICATES, budgets: tuple[int, ...] = BUDGETS, seed: int = 42, score: str = "score", target: str = "target") -> DataFrame:
    """(keys, replicate, scheme, n_pos, ap, roc_auc, tp_<budget>...) of replicates 0..n; replicate 0 is the sample itself.

    Every row is drawn Poisson(1) times, by a hash of its key, score and class; equal rows are added up
    first and drawn together. scheme: resample_accounts, or stratified, where the classes keep their
    sizes. tp counts the hits among the top `budget` rows, a tied group in proportion. Metrics are null
    where a replicate lacks a class. Scores lie within 0..1; null scores are left out, null keys are a key.

    Replicates are blocks, rankings are pieces of the score range: the weights of a (key, piece, block)
    are drawn twice from the same hashes, once for the sums that later pieces start from, once for the
    metrics, slice by slice. settle(df) stores these sums, a few numbers a replicate.
    """
    y, s = F.col(target), F.col(score)
    points = rows.where(s.isNotNull()).groupBy(*keys, (s + 0.0).alias("score")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    piece = F.least(F.greatest(F.floor((1 - F.col("score")) * PIECES_OF_SCORE), F.lit(0)), F.lit(PIECES_OF_SCORE - 1)).cast("int")
    hashed = points.select(*keys, "score", "p", "q", piece.alias("piece"), *(F.xxhash64(F.lit(seed), *keys, "score", F.lit(c)).alias(f"h{c}") for c in "pq"))
    each = settle(hashed).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n // BLOCK)))).withColumn("run", F.xxhash64(*keys, "piece", "block"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    last = n + 1

    def replicates_of(block: int) -> np.ndarray:
        return np.arange(block * BLOCK, min(last, (block + 1) * BLOCK))

    def emit(name: pa.RecordBatch, values: list) -> pa.RecordBatch:
        names = [*keys, *(c for c in ("piece", "block") if c in name.schema.names)]
        return pa.RecordBatch.from_arrays([*(name.column(c) for c in names), *(pa.array([v], pa.list_(pa.float64())) for v in values)], names=[*names, *(f"v{i}" for i in range(len(values)))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None
        for _, is_first, part in run_slices(batches, "run"):
            if is_first:
                if state is not None:
                    yield emit(head, [state.pos, state.neg])
                head, state = part.slice(0, 1), _Sums(replicates_of(part.column("block")[0].as_py()), ())
            state.feed(part, False)
        if state is not None:
            yield emit(head, [state.pos, state.neg])

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums before each piece, and of all pieces; a key's pieces of one block are held, PIECES_OF_SCORE at most."""
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            sums = [[np.asarray(h.column(c)[0].values) for h in held] for c in ("v0", "v1")]
            total = [np.sum(x, axis=0) for x in sums]
            before = [np.zeros_like(t) for t in total]
            for i, h in enumerate(held):
                yield emit(h, [*before, *total])
                before = [b + x[i] for b, x in zip(before, sums)]

        for _, is_first, part in run_slices(batches, "run"):
            if is_first and held:
                yield from finish()
                held = []
            held += [part.slice(i, 1) for i in range(part.num_rows)]
        if held:
            yield from finish()

    by = [*keys, "piece", "block"]
    spread = each.repartition(*by).sortWithinPartitions(*by, F.col("score").desc())
    pieces = settle(spread.mapInArrow(add_up, f"{kinds}, piece int, block int, {_struct('v0 v1')}".lstrip(", ")))
    keyed = pieces.withColumn("run", F.xxhash64(*keys, "block")).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "piece")
    heads = keyed.mapInArrow(offsets, f"{kinds}, piece int, block int, {_struct('v0 v1 v2 v3')}".lstrip(", "))
    sizes = hashed.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    told = heads.join(sizes.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))).drop(*(f"__{k}" for k in keys))
    # the sums before a piece come first in its run, then its points
    both = each.withColumn("is_point", F.lit(1)).unionByName(told.withColumn("run", F.xxhash64(*keys, "piece", "block")).withColumn("is_point", F.lit(0)), allowMissingColumns=True)
    n_out = 1 + 2 * (1 + len(budgets))
    names = [f"v{i}" for i in range(n_out)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, before, state = None, None, None
        result = lambda: [state.roc, *(x for k in range(2) for x in (state.ap[k], *state.tp[k])), *before[2:]]
        for _, is_first, part in run_slices(batches, "run"):
            if is_first:
                if state is not None:
                    yield emit(head, result())
                head = part.slice(0, 1)
                before = [np.asarray(head.column(c)[0].values) for c in ("v0", "v1", "v2", "v3")]
                state = _Sums(replicates_of(head.column("block")[0].as_py()), budgets, *before, head.column("all_p")[0].as_py(), head.column("all_q")[0].as_py())
                part = part.slice(1)
            if part.num_rows:
                state.feed(part, True)
        if state is not None:
            yield emit(head, result())

    ordered = both.repartition(*by).sortWithinPartitions(*by, "is_point", F.col("score").desc())
    measured = ordered.mapInArrow(measure, f"{kinds}, piece int, block int, {_struct(' '.join([*names, 'pos', 'neg']))}".lstrip(", ")).toDF(*keys, "piece", "block", *names, "pos", "neg")
    flat = measured.select(*keys, "block", F.posexplode(F.arrays_zip(*names, "pos", "neg")).alias("at", "v")).select(*keys, (F.col("block") * BLOCK + F.col("at")).alias("replicate"), "v.*")
    summed = flat.groupBy(*keys, "replicate").agg(*(F.sum(c).alias(c) for c in names), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    whole = sizes.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = summed.join(whole, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True)))
    defined, cells, step = (F.col("pos") > 0) & (F.col("neg") > 0), [], 1 + len(budgets)
    for k, scheme in enumerate(SCHEMES):
        pos, size = (F.col("pos"), F.col("pos") + F.col("neg")) if k == 0 else (F.col("all_p").cast("double"), F.col("all_p") + F.col("all_q"))
        hits = [F.when(defined, F.when(size <= b, pos).otherwise(F.col(f"v{1 + k * step + 1 + i}"))).alias(f"tp_{b}") for i, b in enumerate(budgets)]
        cells.append(F.struct(F.lit(scheme).alias("scheme"), pos.alias("n_pos"), F.when(defined, F.col(f"v{1 + k * step}") / pos).alias("ap"), F.when(defined, F.col("v0") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), *hits))
    return joined.select(*keys, "replicate", F.explode(F.array(*cells)).alias("c")).select(*keys, "replicate", "c.*")


def intervals(replicates: DataFrame, keys: list[str], metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """(keys, scheme, metric, point, low, high): the sample's value and the percentile interval of its replicates, which are REPLICATES numbers a key."""
    long = replicates.unpivot([*keys, "scheme", "replicate"], metrics, "metric", "value")
    cut = F.percentile(F.when(F.col("replicate") > 0, F.col("value")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    own = long.groupBy(*keys, "scheme", "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("point"), cut.alias("cut"))
    return own.select(*keys, "scheme", "metric", "point", F.col("cut")[0].alias("low"), F.col("cut")[1].alias("high"))


def paired_sums(pairs: DataFrame, keys: list[str], baseline: str, arm: str) -> DataFrame:
    """(keys, n, mean, sd, n_up, n_down) of arm - baseline over rows that have both."""
    d = F.col(arm) - F.col(baseline)
    own = pairs.where(d.isNotNull()).select(*keys, d.alias("d"))
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.coalesce(F.try_divide(F.stddev_samp("d"), F.lit(1.0)), F.lit(0.0)).alias("sd"), F.count_if(F.col("d") > 0).alias("n_up"), F.count_if(F.col("d") < 0).alias("n_down"))


def detectable_effect(sd: Column, n: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Smallest mean difference found with the usual power."""
    return (z_alpha + z_power) * sd / F.sqrt(n)


def sign_test(up: int, down: int) -> float:
    """Exact two-sided p of the sign test; 1 without differences."""
    n, k = up + down, min(up, down)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2.0**n)


def sign_test_column(up: Column, down: Column) -> Column:
    """The same as a column: the tail of the binomial distribution by logarithms of factorials."""
    n, k = up + down, F.least(up, down)
    log_fact = lambda x: F.aggregate(F.sequence(F.lit(0).cast("bigint"), x.cast("bigint")), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1).cast("bigint")).cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), F.lit(0.0), lambda a, i: a + F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * math.log(2)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def t_critical(df: int, alpha: float = 0.05) -> float:
    """The t value beyond which a two-sided test rejects, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(df / 2, 0.5, df / (df + mid * mid)) > alpha else (low, mid)
    return high


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test(mean: float, sd: float, n: int) -> float:
    """Two-sided p of a mean against 0; 1 where it is undefined."""
    if n < 2 or sd == 0:
        return 1.0 if mean == 0 or n < 2 else 0.0
    t, df = mean / (sd / math.sqrt(n)), n - 1
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon(differences: list[float]) -> float:
    """Exact two-sided p of the signed-rank test for small samples (zeros dropped, ties share ranks)."""
    d = sorted((x for x in differences if x), key=abs)
    if not d:
        return 1.0
    ranks, i = [0.0] * len(d), 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        ranks[i:j] = [(i + j + 1) / 2] * (j - i)
        i = j
    double = [int(2 * r) for r in ranks]
    ways = {0: 1}
    for r in double:
        nxt = dict(ways)
        for s, c in ways.items():
            nxt[s + r] = nxt.get(s + r, 0) + c
        ways = nxt
    seen = sum(r for r, x in zip(double, d) if x > 0)
    low = min(seen, sum(double) - seen)
    return min(1.0, 2 * sum(c for s, c in ways.items() if s <= low) / 2.0 ** len(d))
