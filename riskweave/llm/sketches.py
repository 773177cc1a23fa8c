"""Percentiles of very large numeric columns by dyadic Count-sketches (problem 1).

Values are encoded as integers of BITS bits (a monotone grid over their range). A
sketch holds, for each binary resolution of the codes, the signed counters of a
Count-sketch (DEPTH rows of WIDTH counters); resolutions with no more than WIDTH
nodes are counted exactly. All of it is linear in the counts of the codes, so
sketches merge by addition and take deletions (negative weights). While a group
has few distinct codes, the sketch is kept in its lossless sparse form, the codes'
weights themselves, from which the counters follow by addition when it grows.

A percentile is found by descending the resolutions: from a node whose rank range
holds the target to the child that does. Stated error: the rank of the answer is
off by no more than RANK_ERROR * n (none in the sparse form), and the value by half
a step of the grid.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
WIDTH_BITS = 10
DEPTH = 5
#: Distinct codes up to which a sketch stays sparse.
SPARSE_CODES = 4096
#: Stated rank error as a share of the group's size.
RANK_ERROR = 0.01
#: Distinct (group, code) pairs that a worker holds before it passes its partial sketches on.
WORKER_CODES = 1_500_000

_WIDTH = 1 << WIDTH_BITS
_LOW = BITS - WIDTH_BITS  # resolutions 0.._LOW-1 are sketched, _LOW is exact
_PRIME = np.uint64((1 << 31) - 1)
_COEFFICIENTS = np.random.default_rng(77).integers(1, (1 << 31) - 1, (_LOW, DEPTH, 4), dtype=np.uint64)


def _places(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter number and sign of nodes of one resolution in each row (DEPTH x nodes)."""
    x, c = nodes.astype(np.uint64)[None, :], _COEFFICIENTS[level][:, :, None]
    h = c[:, 3]
    for k in (2, 1, 0):
        h = (h * x + c[:, k]) % _PRIME
    return (h >> np.uint64(1)).astype(np.int64) & (_WIDTH - 1), (h & np.uint64(1)).astype(np.int64) * 2 - 1


class DyadicSketch:
    """Mergeable summary of weighted codes of one group."""

    __slots__ = ("codes", "weights", "exact", "signed", "sparse_codes")

    def __init__(self, sparse_codes: int | None = None):
        self.sparse_codes = SPARSE_CODES if sparse_codes is None else sparse_codes
        self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.exact = self.signed = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> DyadicSketch:
        """Adds (or with negative weights deletes) codes."""
        if self.exact is not None:
            self._count(codes, weights)
            return self
        if len(self.codes):
            codes, weights = np.concatenate((self.codes, codes)), np.concatenate((self.weights, weights))
        self.codes, at = np.unique(codes, return_inverse=True)
        self.weights = np.zeros(len(self.codes), np.int64)
        np.add.at(self.weights, at, weights)
        if not self.weights.all():
            kept = self.weights != 0
            self.codes, self.weights = self.codes[kept], self.weights[kept]
        if len(self.codes) > self.sparse_codes:
            self.densify()
        return self

    def densify(self) -> None:
        """Turns the sparse form into counters."""
        codes, weights = self.codes, self.weights
        self.exact, self.signed = np.zeros(_WIDTH, np.int64), np.zeros((_LOW, DEPTH, _WIDTH), np.int64)
        self.codes, self.weights = codes[:0], weights[:0]
        self._count(codes, weights)

    def _count(self, codes: np.ndarray, weights: np.ndarray) -> None:
        np.add.at(self.exact, codes >> _LOW, weights)
        for level in range(_LOW):
            places, signs = _places(level, codes >> level)
            for row in range(DEPTH):
                self.signed[level, row] += np.bincount(places[row], signs[row] * weights, _WIDTH).astype(np.int64)

    def merge(self, other: DyadicSketch) -> DyadicSketch:
        """Adds another sketch to this one."""
        if other.exact is None:
            return self.add(other.codes, other.weights)
        if self.exact is None:
            self.densify()
        self.exact += other.exact
        self.signed += other.signed
        return self

    def size(self) -> int:
        """Number of values held."""
        return int(self.weights.sum() if self.exact is None else self.exact.sum())

    def estimate(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of nodes of a sketched resolution: the median of the rows' signed counters."""
        places, signs = _places(level, nodes)
        return np.median(np.stack([self.signed[level, r, places[r]] * signs[r] for r in range(DEPTH)]), axis=0)

    def invert(self, fractions: Sequence[float]) -> np.ndarray:
        """Codes at the ranks ceil(fraction * n), at least 1; -1 where the sketch is empty."""
        n = self.size()
        if n <= 0:
            return np.full(len(fractions), -1, np.int64)
        ranks = np.maximum(1, np.ceil(np.asarray(fractions, float) * n - 1e-9))
        counts = self.weights if self.exact is None else self.exact
        sums = np.cumsum(counts)
        node = np.minimum(np.searchsorted(sums, ranks), len(sums) - 1)
        if self.exact is None:
            return self.codes[node]
        left = ranks - (sums[node] - counts[node])
        held = counts[node].astype(float)
        for level in range(_LOW - 1, -1, -1):
            first = np.clip(self.estimate(level, node * 2), 0, held)
            right = left > first
            left, held = np.where(right, left - first, left), np.where(right, held - first, first)
            node = node * 2 + right
        return node

    def dump(self) -> bytes:
        """Bytes of the sketch."""
        if self.exact is None:
            return b"s" + self.codes.astype("<i4").tobytes() + self.weights.astype("<i8").tobytes()
        return b"d" + zlib.compress(self.exact.astype("<i8").tobytes() + self.signed.astype("<i8").tobytes(), 1)

    @staticmethod
    def load(data: bytes, sparse_codes: int | None = None) -> DyadicSketch:
        """A sketch from its bytes."""
        out, body = DyadicSketch(sparse_codes), data[1:]
        if data[:1] == b"s":
            n = len(body) // 12
            out.codes, out.weights = np.frombuffer(body, "<i4", n).astype(np.int64), np.frombuffer(body, "<i8", n, 4 * n).astype(np.int64)
        else:
            both = np.frombuffer(zlib.decompress(body), "<i8").astype(np.int64)
            out.exact, out.signed = both[:_WIDTH].copy(), both[_WIDTH:].reshape(_LOW, DEPTH, _WIDTH).copy()
        return out


def encoded(value: F.Column, low: float, high: float) -> F.Column:
    """Grid code of a value of low..high; null for anything else (null, NaN, out of range)."""
    scaled = (value - F.lit(low)) / F.lit(high - low) * F.lit(float((1 << BITS) - 1))
    return F.when(value.isNotNull() & ~F.isnan(value) & value.between(low, high), F.floor(scaled + 0.5).cast("int"))


def _groups(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number of each row of a batch, and the groups' key values."""
    number, columns = np.zeros(batch.num_rows, np.int64), []
    for key in keys:
        coded = batch.column(key).dictionary_encode(null_encoding="encode")
        columns.append(coded)
        number = number * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        # only the numbers that occur, so that the product stays small
        number = np.unique(number, return_inverse=True)[1]
    first = np.zeros(int(number.max()) + 1, np.int64)
    first[number] = np.arange(batch.num_rows)
    values = [c.take(pa.array(first)).to_pylist() for c in columns]
    return number, list(zip(*values))


class _Partials:
    """Sketches of the groups that one worker meets, in bounded memory."""

    def __init__(self, metrics: list[str], sparse_codes: int | None = None):
        self.sparse_codes = SPARSE_CODES if sparse_codes is None else sparse_codes
        self.metrics, self.group, self.names, self.dense = metrics, {}, [], {}
        self.cells, self.counts, self.fresh, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def take(self, number: np.ndarray, names: list[tuple], codes: list[np.ndarray], weights: np.ndarray) -> None:
        at = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            if (known := self.group.get(name)) is None:
                known = self.group[name] = len(self.names)
                self.names.append(name)
            at[i] = known
        at = at[number] * len(self.metrics)
        for m, code in enumerate(codes):
            valid = code >= 0
            self.fresh.append(((at[valid] + m) << BITS | code[valid], weights[valid]))
            self.held += int(valid.sum())
        if self.held > WORKER_CODES:
            self.compact()

    def compact(self) -> None:
        cells, counts = np.concatenate([self.cells, *(c for c, _ in self.fresh)]), np.concatenate([self.counts, *(w for _, w in self.fresh)])
        self.cells, at = np.unique(cells, return_inverse=True)
        self.counts = np.zeros(len(self.cells), np.int64)
        np.add.at(self.counts, at, counts)
        self.fresh = []
        if len(self.cells) > WORKER_CODES // 2:  # groups with many codes move into counters
            group = self.cells >> BITS
            size = np.bincount(group, minlength=1)
            for g in np.nonzero(size > self.sparse_codes)[0]:
                own = slice(*np.searchsorted(group, (g, g + 1)))
                self.dense.setdefault(int(g), DyadicSketch(self.sparse_codes)).add(self.cells[own] & ((1 << BITS) - 1), self.counts[own])
            rest = size[group] <= self.sparse_codes
            self.cells, self.counts = self.cells[rest], self.counts[rest]
        self.held = len(self.cells)

    def full(self) -> bool:
        return len(self.cells) > WORKER_CODES // 2 or len(self.dense) > 200

    def rows(self) -> Iterator[tuple[tuple, str, DyadicSketch]]:
        if self.fresh:
            self.compact()
        group = self.cells >> BITS
        edges = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            g = int(group[a])
            sketch = self.dense.pop(g, None) or DyadicSketch(self.sparse_codes)
            sketch.add(self.cells[a:b] & ((1 << BITS) - 1), self.counts[a:b])
            yield self.names[g // len(self.metrics)], self.metrics[g % len(self.metrics)], sketch
        for g, sketch in self.dense.items():
            yield self.names[g // len(self.metrics)], self.metrics[g % len(self.metrics)], sketch


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if len(kept) >= at_once or held >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def _key_fields(df: DataFrame, keys: list[str]) -> tuple[str, list[pa.Field]]:
    """Spark and Arrow schema of the key columns (strings, integers and dates)."""
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    return "".join(f"`{k}` {kinds[k]}, " for k in keys), [pa.field(k, arrow[kinds[k]]) for k in keys]


def build_sketches(df: DataFrame, keys: list[str], metrics: dict[str, F.Column], weight: F.Column | None = None, sparse_codes: int | None = None) -> DataFrame:
    """(keys, metric, sketch) with one sketch a group and metric over all rows.

    metrics: for each metric a column of codes (see `encoded`); rows whose code is null are not
    counted there. weight: +1 by default, negative to delete. sparse_codes: SPARSE_CODES by default; 0
    keeps every sketch as counters. Rows with null keys form groups of
    their own. Every partition makes partial sketches where it is read; only those are shuffled,
    so a group of any size costs each reader one bounded sketch. An empty table has no group.
    """
    names = list(metrics)
    spark_keys, fields = _key_fields(df, keys)
    schema = pa.schema([*fields, pa.field("metric", pa.string()), pa.field("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = _Partials(names, sparse_codes)
            for batch in batches:
                if not batch.num_rows:
                    continue
                number, groups = _groups(batch, keys)
                codes = [batch.column(f"__code{i}").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names))]
                held.take(number, groups, codes, batch.column("__weight").to_numpy(zero_copy_only=False))
                if held.full():
                    yield from ((*g, m, s.dump()) for g, m, s in held.rows())
                    held = _Partials(names, sparse_codes)
            yield from ((*g, m, s.dump()) for g, m, s in held.rows())

        yield from _batches(rows(), schema)

    one = F.lit(1) if weight is None else weight
    source = df.select(*keys, *(c.alias(f"__code{i}") for i, c in enumerate(metrics.values())), one.cast("bigint").alias("__weight"))
    partial = source.mapInArrow(run, f"{spark_keys}metric string, sketch binary")
    return merge_sketches(partial, keys, sparse_codes)


def merge_sketches(sketches: DataFrame, keys: list[str], sparse_codes: int | None = None) -> DataFrame:
    """Adds the sketches of equal keys and metric: days into weeks, partitions into a whole.

    The rows of a group stream, sorted, into one sketch; none is collected.
    """
    spark_keys, fields = _key_fields(sketches, keys)
    schema = pa.schema([*fields, pa.field("metric", pa.string()), pa.field("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held = None, None
            for batch in batches:
                for *name, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "metric", "sketch"))):
                    if name != now:
                        if now is not None:
                            yield (*now, held.dump() if isinstance(held, DyadicSketch) else held)
                        now, held = name, data
                    else:
                        held = (held if isinstance(held, DyadicSketch) else DyadicSketch.load(held, sparse_codes)).merge(DyadicSketch.load(data))
            if now is not None:
                yield (*now, held.dump() if isinstance(held, DyadicSketch) else held)

        yield from _batches(rows(), schema)

    by = [*keys, "metric"]
    sorted_rows = sketches.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(run, f"{spark_keys}metric string, sketch binary")


def percentiles(sketches: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], fractions: dict[str, float]) -> DataFrame:
    """(keys, metric, n, one column per fraction) of every sketch that holds a value."""
    spark_keys, fields = _key_fields(sketches, keys)
    schema = pa.schema([*fields, pa.field("metric", pa.string()), pa.field("n", pa.int64()), *(pa.field(f, pa.float64()) for f in fractions)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *name, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "metric", "sketch"))):
                    sketch = DyadicSketch.load(data)
                    n = sketch.size()
                    if n > 0:
                        low, high = ranges[name[-1]]
                        yield (*name, n, *(float(low + (high - low) * c / ((1 << BITS) - 1)) for c in sketch.invert(list(fractions.values()))))

        yield from _batches(rows(), schema)

    columns = ", ".join(f"`{f}` double" for f in fractions)
    return sketches.mapInArrow(run, f"{spark_keys}metric string, n bigint, {columns}")


def exact_ranks(codes: DataFrame, answers: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], fractions: dict[str, float]) -> DataFrame:
    """(keys, metric, n, is_whole, fraction, rank_error): how far the rank of each answer of `percentiles` is from the wanted one, as a share of n.

    codes: (keys, metric, code, n), the exact counts; is_whole: the sketch holds as many values. Each
    count meets the one row of its group's answers, so nothing is multiplied. A group without an answer
    or with a null key has no row.
    """
    code = lambda name: F.coalesce(*(F.when(F.col("metric") == m, encoded(F.col(name), *span)) for m, span in ranges.items()))
    wanted = answers.select(*keys, "metric", F.col("n").alias("__all"), *(code(f).alias(f) for f in fractions))
    sums = [F.sum(F.when(F.col("code") < F.col(f), F.col("n")).otherwise(0)).alias(f"below_{f}") for f in fractions] + [F.sum(F.when(F.col("code") == F.col(f), F.col("n")).otherwise(0)).alias(f"at_{f}") for f in fractions]
    placed = codes.join(wanted, [*keys, "metric"]).groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.max("__all").alias("__all"), *sums)
    cells = []
    for f, q in fractions.items():
        rank = F.greatest(F.lit(1.0), F.ceil(F.lit(q) * F.col("n") - 1e-9).cast("double"))
        off = F.greatest(F.lit(0.0), F.col(f"below_{f}") + 1 - rank, rank - F.col(f"below_{f}") - F.col(f"at_{f}"))
        cells.append(F.struct(F.lit(f).alias("fraction"), (off / F.col("n")).alias("rank_error")))
    return placed.select(*keys, "metric", "n", (F.col("n") == F.col("__all")).alias("is_whole"), F.explode(F.array(*cells)).alias("c")).select(*keys, "metric", "n", "is_whole", "c.*")
