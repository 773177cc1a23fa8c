"""Mixed-type similarity and nearest rows of a stated query set.

Rows are encoded as arrays; queries visit every block of reference rows and leave
their k best there, so a task holds one block and the queries, and the results of
the blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_runs import key_runs
from .quantiles import linear_quantiles, value_counts
from .ranking import divide

#: Scale is SCALE_IQR interquartile ranges; similarity bands by percentile (fixed values).
SCALE_IQR, EPS = 4.0, 1e-9
BANDS = ((99.5, "VERY_HIGH"), (99.0, "HIGH"), (95.0, "MODERATE"))
#: Rows of a reference block.
BLOCK_ROWS = 20_000
_OUT = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("distance", pa.float64())])


def gower_fit(long: DataFrame) -> DataFrame:
    """(feature, median, iqr, lower, upper, scale): 1st..99th percentile bounds, and the scale 4 IQR, else their width, else 1."""
    q = linear_quantiles(value_counts(long, ["feature"]), ["feature"], {"q1": 0.25, "median": 0.5, "q3": 0.75, "lower": 0.01, "upper": 0.99})
    iqr, width = F.col("q3") - F.col("q1"), F.col("upper") - F.col("lower")
    scale = F.when(SCALE_IQR * iqr > EPS, SCALE_IQR * iqr).when(width > EPS, width).otherwise(1.0)
    return q.select("feature", "median", iqr.alias("iqr"), "lower", "upper", scale.alias("scale"))


def topk_in_blocks(reference: DataFrame, queries: DataFrame, k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, row, distance, rank): the k nearest reference rows of every query, ties by the smaller row; a row is not its own neighbour.

    Both inputs are (row bigint, v array<double>); distance maps query and block matrices to a
    matrix. Null arrays have no neighbours.
    """
    n_blocks = max(1, -(-reference.count() // block_rows))
    own = reference.where("v IS NOT NULL").select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"), F.lit(0).alias("role"), "row", "v")
    asked = queries.where("v IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"), F.lit(1).alias("role"), "row", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_runs(batches, "block"):
            role = rows["role"].to_numpy()
            ids = rows["row"].to_numpy()
            values = rows["v"].combine_chunks()
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
            matrix = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)
            ref, ask = role == 0, np.nonzero(role == 1)[0]
            if not ref.any():
                continue
            order = np.argsort(ids[ref], kind="stable")
            block, names = matrix[ref][order], ids[ref][order]
            for at in range(0, len(ask), 256):
                part = ask[at : at + 256]
                d = distance(matrix[part], block)
                d[names[None, :] == ids[part][:, None]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(d, best, 1)
                fine = np.isfinite(got)
                q = np.repeat(ids[part], best.shape[1]).reshape(best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(q[fine]), pa.array(names[best][fine]), pa.array(got[fine])], schema=_OUT)

    tasks = 4 * reference.sparkSession.sparkContext.defaultParallelism
    found = own.union(asked).repartition(tasks, "block").sortWithinPartitions("block", "role").mapInArrow(run, "query bigint, row bigint, distance double")
    nearest = Window.partitionBy("query").orderBy(F.round("distance", 12), "row")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def euclidean(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Euclidean distances."""
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T))


def gower_distance(weights: np.ndarray, scales: np.ndarray, n_numeric: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Weighted disagreement 0..1: numeric |a-b| / scale up to 1, codes equal or not; missing (NaN) on one side counts 1, on both 0."""

    def distance(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(r)))
        for j, w in enumerate(weights):
            a, b = q[:, j][:, None], r[:, j][None, :]
            with np.errstate(invalid="ignore"):
                d = np.minimum(np.abs(a - b) / scales[j], 1.0) if j < n_numeric else (a != b).astype(float)
            na, nb = np.isnan(a), np.isnan(b)
            out += w * np.where(na & nb, 0.0, np.where(na | nb, 1.0, d))
        return out

    return distance


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """(query, row): pairs that name each other; neighbours holds the lists of both ends."""
    other = neighbours.select(F.col("row").alias("query"), F.col("query").alias("row"))
    return neighbours.select("query", "row").join(other, ["query", "row"], "left_semi")


def cohort_summary(neighbours: DataFrame) -> DataFrame:
    """(query, n_neighbours, n_high_risk, median_risk, max_risk) of neighbours with risk and tier; lists are bounded by k."""
    high = F.col("tier").isin("CRITICAL_REVIEW", "URGENT_REVIEW")
    return neighbours.groupBy("query").agg(F.count(F.lit(1)).alias("n_neighbours"), F.count_if(high).alias("n_high_risk"), F.percentile("risk", F.lit(0.5)).alias("median_risk"), F.max("risk").alias("max_risk"))


def retrieval_quality(neighbours: DataFrame, prevalence: float | Column, k: int) -> DataFrame:
    """(query_label, n_queries, hit, prevalence, mean_positives, lift) at k, of neighbours with query_label and label."""
    per = neighbours.where(F.col("rank") <= k).groupBy("query_label", "query").agg(F.max("label").alias("hit"), F.avg(F.col("label").cast("double")).alias("share"), F.sum("label").alias("n_pos"))
    out = per.groupBy("query_label").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("hit").cast("double")).alias("hit"), F.avg("share").alias("prevalence"), F.avg("n_pos").alias("mean_positives"))
    base = F.lit(prevalence) if isinstance(prevalence, float) else prevalence
    return out.withColumn("lift", divide(F.col("prevalence"), base))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets, 0 if both are empty."""
    return F.coalesce(divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def interpolated(value: Column, grid: list[tuple[float, float]]) -> Column:
    """Linear interpolation over (x, y) points, held constant outside; for small, fixed grids."""
    out = F.lit(grid[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(grid, grid[1:]))):
        out = F.when(value <= x1, F.lit(y0) + (value - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(value <= grid[0][0], F.lit(grid[0][1])).otherwise(out)


def similarity_band(percentile: Column) -> Column:
    """VERY_HIGH, HIGH, MODERATE or TYPICAL."""
    out = F.lit("TYPICAL")
    for cut, name in reversed(BANDS):
        out = F.when(percentile >= cut, name).otherwise(out)
    return out
