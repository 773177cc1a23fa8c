"""Profiles of wide tables and the audit of columns that give the label away.

A table is unpivoted to (feature, value) and counted once per distinct value; all
figures of a column follow from its value counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_runs import key_runs
from ..session import checked_broadcast
from .quantiles import linear_quantiles, running_counts, value_bucket, value_counts
from .ranking import divide, pearson

#: Limits of the audit (fixed values).
QUASI_CONSTANT, CORRELATION, SINGLE_AP, RECONSTRUCTION, AUC_EDGE, ID_RATIO, ID_VALUES, MOST_LEVELS = 0.99, 0.95, 0.90, 0.95, 0.999, 0.98, 1000, 25
#: Rows up to which a column's distinct values are held as one piece, and pieces whose offsets are broadcast at most (40 bytes each).
WHOLE_ROWS, MOST_PIECES = 2_000_000, 1_000_000
_NUMERIC = re.compile("tinyint|smallint|int|bigint|float|double|decimal.*")
QUANTILES = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


def long_form(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value) with nulls kept; NaN becomes null."""
    clean = df.select(*keys, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    return clean.unpivot(keys, columns, "feature", "value")


def _piece(values: np.ndarray, bits: int) -> np.ndarray:
    """Number of the range a value lies in: the leading bits of its order-preserving 64-bit form; 0 without bits."""
    raw = values.view(np.int64)
    ordered = np.where(raw < 0, ~raw, raw | np.int64(-(1 << 63))).view(np.uint64)
    return (ordered >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.nonzero(np.concatenate(([True], values[1:] != values[:-1])))[0]
    return values[starts], np.add.reduceat(counts, starts)


_HELD = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("held", pa.binary())])
_HELD_DDL = "slot bigint, n bigint, total double, held binary"


def _held(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cells = [(slot, n, float((v * c).sum()), v.tobytes() + c.tobytes()) for slot, n, v, c in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells), _HELD)], schema=_HELD)


def _values_of(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(held) // 16
    return np.frombuffer(held, np.float64, half), np.frombuffer(held, np.int64, half, 8 * half)


def value_pieces(df: DataFrame, columns: list[str], bits: int = 0) -> DataFrame:
    """(slot, n, total, held): the distinct values of every column with their counts, in pieces of the value range.

    slot is column number << 13 | piece; piece 2**13 - 1 has the number of rows and no values. NaN counts as
    missing, -0.0 as 0.0. Each batch counts its columns where it is read, and equal pieces are added after one
    shuffle: what travels is a column's distinct values once a task, not its cells.
    """
    rows_slot = (1 << 13) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for i, column in enumerate(batch.columns):
                out.append((i << 13 | rows_slot, batch.num_rows, np.zeros(0), np.zeros(0, np.int64)))
                values = column.drop_null().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                values = values[values == values] + 0.0
                if not len(values):
                    continue
                values, counts = _counted(values, np.ones(len(values), np.int64))
                pieces = _piece(values, bits)
                cuts = np.concatenate((np.nonzero(np.concatenate(([True], pieces[1:] != pieces[:-1])))[0], [len(values)]))
                out += [(i << 13 | int(pieces[x]), int(counts[x:y].sum()), values[x:y], counts[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
            for at in range(0, len(out), 2000):
                yield _held(out[at : at + 2000])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for slot, rows in key_runs(batches, "slot"):
            n, blobs = sum(rows["n"].to_pylist()), rows["held"].to_pylist()
            parts = [_values_of(h) for h in blobs]
            values, counts = parts[0] if len(parts) == 1 or not blobs[0] else _counted(*(np.concatenate(x) for x in zip(*parts)))
            done.append((int(slot), n, values, counts))
            if len(done) >= 500:
                yield _held(done)
                done = []
        if done:
            yield _held(done)

    kinds = dict(df.dtypes)
    # numbers are converted where they are counted: a cast for each of thousands of columns costs the driver more
    plain = [f"`{c}`" if _NUMERIC.fullmatch(kinds[c]) else F.col(f"`{c}`").cast("double") for c in columns]
    return df.select(*plain).mapInArrow(count, _HELD_DDL).repartition("slot").sortWithinPartitions("slot").mapInArrow(merge, _HELD_DDL)


def profile_columns(df: DataFrame, columns: list[str], settle) -> DataFrame:
    """One row per column: rows, missing rate, distinct values, top value and share, constancy, zeros, range, moments, quantiles.

    Exact. Up to WHOLE_ROWS rows a column is one piece, beyond it its value range is cut into up to 4,096
    pieces, so that no task holds a column. settle(df) stores the pieces, which are read twice.
    """
    bits = 0 if df.limit(WHOLE_ROWS + 1).count() <= WHOLE_ROWS else 12
    pieces = settle(value_pieces(df, columns, bits)).withColumns({"col": F.shiftright("slot", 13), "piece": F.col("slot").bitwiseAND((1 << 13) - 1)})
    valued = pieces.where(F.col("piece") < (1 << 13) - 1)
    before = Window.partitionBy("col").orderBy("piece")  # at most 4,096 rows a column
    whole = Window.partitionBy("col")
    offsets = valued.select("slot", (F.sum("n").over(before) - F.col("n")).alias("o"), F.sum("n").over(whole).alias("all"), (F.sum("total").over(whole) / F.sum("n").over(whole)).alias("mean"))
    names = [f"{side}_{q}" for q in QUANTILES for side in ("l", "h")]
    figures = ("n_unique", "top_n", "zeros"), ("top_value", "low", "high", "ssd")
    schema = pa.schema([("col", pa.int64()), ("n", pa.int64()), *((c, pa.int64()) for c in figures[0]), *((c, pa.float64()) for c in figures[1]), ("is_integer", pa.bool_()), *((c, pa.float64()) for c in names)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slot, n, held, offset, total, mean in zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "held", "o", "all", "mean"))):
                v, c = _values_of(held)
                best, cum = int(c.argmax()), offset + np.cumsum(c)
                at = []
                for q in QUANTILES.values():
                    low = int(np.floor((total - 1) * q))
                    at += [float(v[np.searchsorted(cum, rank, "right")]) if offset <= rank < offset + n else None for rank in (low, min(low + 1, total - 1))]
                rows.append((slot >> 13, n, len(v), int(c[best]), int(c[v == 0].sum()), float(v[best]), float(v[0]), float(v[-1]), float((c * (v - mean) ** 2).sum()), bool((v == np.floor(v)).all()), *at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    ddl = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'boolean' if f.type == pa.bool_() else 'bigint'}" for f in schema)
    parts = valued.select("slot", "n", "held").join(checked_broadcast(settle(offsets), MOST_PIECES), "slot").select("slot", "n", "held", "o", "all", "mean").mapInArrow(measure, ddl)
    top = F.max(F.struct("top_n", (-F.col("top_value")).alias("m")))
    sums = parts.groupBy("col").agg(
        F.sum("n").alias("n_valued"), F.sum("n_unique").alias("n_unique"), top["top_n"].alias("top_n"), (-top["m"] + 0.0).alias("top_value"), F.sum("zeros").alias("zeros"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sqrt(F.sum("ssd") / F.sum("n")).alias("std"), F.bool_and("is_integer").alias("is_integer"), *(F.max(c).alias(c) for c in names),
    )
    sizes = pieces.where(F.col("piece") == (1 << 13) - 1).select("col", F.col("n").alias("n_rows"))
    means = valued.groupBy("col").agg((F.sum("total") / F.sum("n")).alias("mean"))
    named = df.sparkSession.createDataFrame(list(enumerate(columns)), "col bigint, feature string")
    out = named.join(sizes, "col").join(sums, "col", "left").join(means, "col", "left")
    unique, valued_n = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_unique", "n_valued"))
    share = F.coalesce(divide(F.col("top_n"), F.col("n_valued")), F.lit(1.0))
    missing = 1 - valued_n / F.col("n_rows")
    weight = lambda q: (F.col("n_valued") - 1) * F.lit(q) - F.floor((F.col("n_valued") - 1) * F.lit(q))
    cuts = [(F.col(f"l_{n}") + (F.col(f"h_{n}") - F.col(f"l_{n}")) * weight(q)).alias(n) for n, q in QUANTILES.items()]
    return out.select(
        "feature", "n_rows", (F.col("n_rows") - valued_n).alias("n_missing"), missing.alias("missing_rate"), unique.alias("n_unique"), (unique <= 1).alias("is_constant"), "top_value", share.alias("top_share"),
        ((unique <= 1) | (share >= QUASI_CONSTANT) | (missing >= QUASI_CONSTANT)).alias("is_quasi_constant"), divide(F.col("zeros"), F.col("n_valued")).alias("zero_rate"), "low", "high", "mean", "std", *cuts, "is_integer",
    )


def top_values(long: DataFrame, k: int = 5) -> DataFrame:
    """(feature, place, value, n): the k most frequent values, ties by the lower value."""
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    return value_counts(long, ["feature"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("feature", "place", "value", "n")


def duplicate_columns(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(feature, duplicate_of): the first column of the frame with the same content, null if a column is the first of its kind.

    Contents are compared by two order-free hashes over (row, value); -0.0 is 0.0 and missing one value.
    """
    clean = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) + 0.0, F.lit(3.14e17)) for c in columns]
    one = df.agg(*(F.struct(F.bit_xor(F.xxhash64(F.col(row), c)).alias("a"), F.bit_xor(F.xxhash64(c, F.col(row), F.lit(5))).alias("b")).alias(n) for c, n in zip(clean, columns)))
    rows = one.unpivot([], columns, "feature", "digest")
    place = F.array_position(F.array(*(F.lit(c) for c in columns)), F.col("feature"))
    first = F.min_by("feature", place).over(Window.partitionBy("digest"))  # one row a column
    return rows.select("feature", F.when(first != F.col("feature"), first).alias("duplicate_of"))


def label_correlation(long: DataFrame, target: str = "target") -> DataFrame:
    """(feature, n, r): Pearson correlation with the label over the rows that have a value; 0 below ten of them or where undefined."""
    own = long.where("value IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("value"), F.col(target).cast("double")).alias("r"))
    return own.select("feature", "n", F.when((F.col("n") < 10) | F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")).alias("r"))


def mutual_information(long: DataFrame, target: str = "target", bins: int = 10) -> DataFrame:
    """(feature, mi_bits): information between a column's decile bins (missing is a bin) and the label, within 0..H(label)."""
    cuts = {f"d{i}": i / bins for i in range(1, bins)}
    counts = value_counts(long, ["feature"])
    edges = linear_quantiles(counts, ["feature"], cuts).select("feature", F.array_distinct(F.array(*cuts)).alias("edges"))
    spread = counts.groupBy("feature").agg((F.count(F.lit(1)) <= 1).alias("flat"))
    marked = long.join(edges, "feature", "left").join(spread, "feature", "left")
    bin_ = F.when(F.col("value").isNull(), 0).when(F.col("flat"), 1).otherwise(1 + F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    cells = marked.groupBy("feature", bin_.alias("bin"), F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    by_bin, by_y, whole = (Window.partitionBy(*k) for k in (("feature", "bin"), ("feature", "y"), ("feature",)))  # at most 2 * (bins + 2) cells a feature
    n, total = F.col("n"), F.sum("n").over(whole)
    terms = cells.select("feature", (n / total * F.log2(n * total / (F.sum("n").over(by_bin) * F.sum("n").over(by_y)))).alias("t"))
    p = long.groupBy("feature").agg(F.avg(F.col(target).cast("double")).alias("p"))
    h = -(F.col("p") * F.log2("p") + (1 - F.col("p")) * F.log2(1 - F.col("p")))
    return terms.groupBy("feature").agg(F.sum("t").alias("mi")).join(p, "feature").select("feature", F.greatest(F.lit(0.0), F.when((F.col("p") > 0) & (F.col("p") < 1), F.least("mi", h)).otherwise(F.col("mi"))).alias("mi_bits"))


def label_reconstruction(long: DataFrame, target: str = "target") -> DataFrame:
    """(feature, rate): balanced match of mapping each value to its majority class; 0 unless 2..MOST_LEVELS values and both classes."""
    y = F.col(target).cast("bigint")
    levels = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"))
    says = F.col("p") / F.col("n") >= 0.5
    sums = levels.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"), F.sum(F.when(says, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(~says, F.col("n") - F.col("p")).otherwise(0)).alias("tn"))
    fit = F.col("k").between(2, MOST_LEVELS) & (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select("feature", F.when(fit, (F.col("tp") / F.when(F.col("pos") > 0, F.col("pos")) + F.col("tn") / F.when(F.col("neg") > 0, F.col("neg"))) / 2).otherwise(0.0).alias("rate"))


def single_feature_scores(long: DataFrame, folds: int, fold: str = "fold", target: str = "target") -> DataFrame:
    """(feature, ap, auc): fold means of ranking the held-out fold by one column.

    Missing values take the training folds' median; the direction is the one with the better training AP.
    long: (feature, value, fold of 0..folds-1, target). A column is counted once per distinct value, with a
    count for each fold and class; the training folds are the total less the held one, and the falling
    order's sums are the total less the rising one's, so no row is repeated for a fold or a direction.
    Running sums are taken in pieces of the value range.
    """
    v, y, f = F.col("value"), F.col(target), F.col(fold)
    cell = lambda i, k: F.count_if((f == i) & (y == k))
    classes = [(i, k) for i in range(folds) for k in (0, 1)]
    counts = long.groupBy("feature", (v + 0.0).alias("value")).agg(*(cell(i, k).alias(f"c{i}{k}") for i, k in classes))
    known, lost = counts.where("value IS NOT NULL"), counts.where("value IS NULL").drop("value").withColumnsRenamed({f"c{i}{k}": f"z{i}{k}" for i, k in classes})
    every = [f"c{i}{k}" for i, k in classes]
    n_fold = lambda i: F.col(f"c{i}0") + F.col(f"c{i}1")
    all_n = reduce(Column.__add__, [n_fold(i) for i in range(folds)])

    def running(points: DataFrame, columns: list[str]) -> DataFrame:
        """points with up_<c>: the sum of c over the values up to this one, and all_<c>."""
        marked = points.withColumn("__b", value_bucket(F.col("value")))
        before, whole = Window.partitionBy("feature").orderBy("__b"), Window.partitionBy("feature")
        sums = marked.groupBy("feature", "__b").agg(*(F.sum(c).alias(c) for c in columns))
        offsets = sums.select("feature", "__b", *((F.sum(c).over(before) - F.col(c)).alias(f"o_{c}") for c in columns), *(F.sum(c).over(whole).alias(f"all_{c}") for c in columns))
        inside = Window.partitionBy("feature", "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return marked.join(offsets, ["feature", "__b"]).select("feature", "value", *columns, *((F.col(f"o_{c}") + F.sum(c).over(inside)).alias(f"up_{c}") for c in columns), *(f"all_{c}" for c in columns))

    # medians of the training folds of each held one, by linear interpolation
    trained = known.select("feature", "value", *((all_n - n_fold(i)).alias(f"t{i}") for i in range(folds)))
    ranks = running(trained, [f"t{i}" for i in range(folds)])
    aggs = []
    for i in range(folds):
        place = (F.col(f"all_t{i}") - 1) / 2.0
        at = lambda r, i=i: (F.col(f"up_t{i}") > r) & (F.col(f"up_t{i}") - F.col(f"t{i}") <= r)
        low = F.floor(place)
        aggs += [F.max(F.when(at(low), v)).alias(f"l{i}"), F.max(F.when(at(F.least(low + 1, F.col(f"all_t{i}") - 1)), v)).alias(f"h{i}"), F.max(place - low).alias(f"w{i}")]
    medians = ranks.groupBy("feature").agg(*aggs).select("feature", *(F.coalesce(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * F.col(f"w{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(folds)))
    # the missing rows lie at the median of each held fold, which may be a value of its own
    zero = F.lit(0).cast("bigint")
    gaps = long.select("feature").distinct().join(lost, "feature", "left").join(medians, "feature", "left").fillna(0, [f"z{i}{k}" for i, k in classes]).fillna(0.0, [f"m{i}" for i in range(folds)])
    sides = [(s, i, k) for s in ("h", "t") for i in range(folds) for k in (0, 1)]  # held or trained, held fold, class

    def of(prefix: str, side: str, i: int, k: int) -> Column:
        return F.col(f"{prefix}{i}{k}") if side == "h" else reduce(Column.__add__, [F.col(f"{prefix}{j}{k}") for j in range(folds) if j != i], zero)

    placed = [F.struct(F.col(f"m{j}").alias("value"), *((of("z", s, i, k) if i == j else zero).alias(f"{s}{i}{k}") for s, i, k in sides)) for j in range(folds)]
    extra = gaps.select("feature", F.explode(F.array(*placed)).alias("x")).select("feature", "x.*")
    own = known.select("feature", "value", *(of("c", s, i, k).alias(f"{s}{i}{k}") for s, i, k in sides))
    names = [f"{s}{i}{k}" for s, i, k in sides]
    points = own.unionByName(extra).groupBy("feature", "value").agg(*(F.sum(c).alias(c) for c in names))
    run = running(points, names)
    aggs = []
    for side in ("h", "t"):
        for i in range(folds):
            q, p = (F.col(f"{side}{i}{k}").cast("double") for k in (0, 1))
            up_q, up_p, all_q, all_p = (F.col(f"{pre}_{side}{i}{k}").cast("double") for pre in ("up", "all") for k in (0, 1))
            for way, cq, cp in (("up", all_q - up_q + q, all_p - up_p + p), ("down", up_q, up_p)):  # "up": the highest value first
                aggs.append(F.sum(F.when(p > 0, p * cp / F.when(cp + cq > 0, cp + cq))).alias(f"ap_{side}{i}_{way}"))
                if side == "h":
                    aggs.append(F.sum(q * (cp - p / 2)).alias(f"roc_{i}_{way}"))
            if side == "h":
                aggs += [F.max(all_p).alias(f"p{i}"), F.max(all_q).alias(f"q{i}")]
            else:
                aggs.append(F.max(all_p).alias(f"tp{i}"))
    got = run.groupBy("feature").agg(*aggs)
    fold_scores = []
    for i in range(folds):
        trained_ap = lambda way, i=i: F.round(divide(F.col(f"ap_t{i}_{way}"), F.col(f"tp{i}")), 12)
        rises = (F.coalesce(trained_ap("up"), F.lit(-1.0)) >= F.coalesce(trained_ap("down"), F.lit(-1.0)))
        held = (F.col(f"p{i}") > 0) & (F.col(f"q{i}") > 0)
        pick = lambda c: F.when(rises, F.col(c.format("up"))).otherwise(F.col(c.format("down")))
        fold_scores.append(F.struct(F.when(held, pick(f"ap_h{i}_{{}}") / F.col(f"p{i}")).alias("ap"), F.when(held, pick(f"roc_{i}_{{}}") / (F.col(f"p{i}") * F.col(f"q{i}"))).alias("auc")))
    return got.select("feature", F.explode(F.array(*fold_scores)).alias("s")).groupBy("feature").agg(F.avg("s.ap").alias("ap"), F.avg("s.auc").alias("auc"))


def _ranking(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Sums for AP and ROC-AUC of a column, highest value first and lowest value first, ties sharing a rank."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    starts = np.nonzero(np.concatenate(([True], x[1:] != x[:-1])))[0]
    p, n = np.add.reduceat(y, starts), np.diff(np.append(starts, len(x)))
    out = []
    for a, b in ((p[::-1], n[::-1]), (p, n)):
        cp, cn = np.cumsum(a), np.cumsum(b)
        out += [float((a * cp / cn).sum()), float(((b - a) * (cp - a / 2)).sum())]
    return tuple(out)


def _fold_scores(x: np.ndarray, fold: np.ndarray, y: np.ndarray, folds: int) -> tuple[float | None, float | None]:
    """Means over the held-out folds of AP and ROC-AUC of one whole column, as of `single_feature_scores`."""
    lost, found = np.isnan(x), []
    for held in range(folds):
        own = fold == held
        known = x[~own & ~lost]
        filled = np.where(lost, np.median(known) if len(known) else 0.0, x)
        pos, neg = y[own].sum(), (1 - y[own]).sum()
        if not (pos and neg):
            continue
        up, _, down, _ = _ranking(filled[~own], y[~own]) if (~own).any() else (0.0, 0.0, 0.0, 0.0)
        trained = y[~own].sum()
        rises = not trained or round(up / trained, 12) >= round(down / trained, 12)
        ap_up, roc_up, ap_down, roc_down = _ranking(filled[own], y[own])
        found.append((ap_up / pos, roc_up / (pos * neg)) if rises else (ap_down / pos, roc_down / (pos * neg)))
    return tuple(float(np.mean(c)) for c in zip(*found)) if found else (None, None)


def column_scores(df: DataFrame, columns: list[str], folds: int, fold: str = "fold", target: str = "target") -> DataFrame:
    """(feature, ap, auc) as of `single_feature_scores`, for the columns of a wide table.

    Up to WHOLE_ROWS rows a column fits a task: its values travel as one block a batch, with no name and no
    row for each cell. Beyond it columns are counted and ranked in pieces. Exact and equal both ways; rows
    without a fold of 0..folds-1 or a label are left out.
    """
    rows = df.where(F.col(fold).between(0, folds - 1) & F.col(target).isin(0, 1))
    if rows.limit(WHOLE_ROWS + 1).count() > WHOLE_ROWS:
        return single_feature_scores(long_form(rows, columns, [fold, target]), folds, fold, target)
    names, schema = list(columns), pa.schema([("slot", pa.int64()), ("held", pa.binary())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = (batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False) * 2 + batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).astype(np.int8).tobytes()
            for at in range(0, len(names), 1000):
                blocks = [batch.column(i).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tobytes() + code for i in range(at, min(at + 1000, len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], schema=schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, blocks in key_runs(batches, "slot"):
            parts = [(np.frombuffer(h, np.float64, len(h) // 9), np.frombuffer(h, np.int8, len(h) // 9, len(h) // 9 * 8)) for h in blocks["held"].to_pylist()]
            x, code = (np.concatenate(c) for c in zip(*parts))
            ap, auc = _fold_scores(x + 0.0, code // 2, (code % 2).astype(np.int64), folds)
            yield pa.RecordBatch.from_arrays([pa.array([names[slot]]), pa.array([ap], pa.float64()), pa.array([auc], pa.float64())], names=["feature", "ap", "auc"])

    kinds = dict(df.dtypes)
    plain = [f"`{c}`" if _NUMERIC.fullmatch(kinds[c]) else F.col(f"`{c}`").cast("double") for c in columns]
    blocks = rows.select(*plain, F.col(fold).cast("int").alias("__fold"), F.col(target).cast("int").alias("__target")).mapInArrow(cells, "slot bigint, held binary")
    return blocks.repartition("slot").sortWithinPartitions("slot").mapInArrow(judge, "feature string, ap double, auc double")


def leakage_flags(profile: DataFrame, correlation: DataFrame, single: DataFrame, reconstruction: DataFrame) -> DataFrame:
    """(feature, flags): the grounds on which a column may give the label away, joined by commas."""
    rows = profile.join(correlation.select("feature", "r"), "feature", "left").join(single, "feature", "left").join(reconstruction, "feature", "left")
    c = F.col
    grounds = [
        F.when(F.abs("r") >= CORRELATION, "high_correlation"), F.when(c("ap") >= SINGLE_AP, "high_single_ap"), F.when(c("rate") >= RECONSTRUCTION, "label_reconstruction"),
        F.when((c("auc") >= AUC_EDGE) | (c("auc") <= 1 - AUC_EDGE), "extreme_auc"),
        F.when(c("is_integer") & (c("n_unique") / c("n_rows") >= ID_RATIO) & (c("n_unique") > ID_VALUES), "identifier_like"),
    ]
    return rows.select("feature", F.array_join(F.array_compact(F.array(*grounds)), ",").alias("flags"))


def kolmogorov_smirnov(long: DataFrame, side: str) -> DataFrame:
    """(feature, ks): the largest gap of the two sides' distribution functions. side: boolean column."""
    counts = long.where("value IS NOT NULL").groupBy("feature", F.col("value").cast("double").alias("value"), F.col(side).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    tagged = counts.groupBy("feature", "value").agg(F.sum(F.when(F.col("s"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("s"), F.col("n")).otherwise(0)).alias("b"))
    run_a = running_counts(tagged.select("feature", "value", F.col("a").alias("n")), ["feature"]).select("feature", "value", F.col("cum_n").alias("ca"), F.col("total").alias("ta"))
    run_b = running_counts(tagged.select("feature", "value", F.col("b").alias("n")), ["feature"]).select("feature", "value", F.col("cum_n").alias("cb"), F.col("total").alias("tb"))
    return run_a.join(run_b, ["feature", "value"]).groupBy("feature").agg(F.max(F.abs(divide(F.col("ca"), F.col("ta")) - divide(F.col("cb"), F.col("tb")))).alias("ks"))
