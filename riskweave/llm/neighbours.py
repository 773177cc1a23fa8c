"""Most similar vectors for every vector (problem 4).

Vectors with a coordinate for each position of the registry, some missing, are compared by the root of the
sum of ((a-b)/scale)^2 over coordinates present in both plus the count of those
present in only one. They are projected onto PROJECTIONS random directions with
normal (2-stable) entries, so that a projected distance divided by the true one
follows the root of a chi-square variable. The projections are indexed by kd-trees:
one, fit on a bounded sample, cuts the space into cells that fit a task; each cell
builds its own tree over all of its vectors. A query looks at the projected
neighbours in order of their distance and verifies each; it stops by the chi-square
test: once a vector nearer than the k-th best found would, with the stated
CONFIDENCE, have been met at a smaller projected distance.

A query first searches its own cell; what it has found bounds how far it must look,
and only cells within that bound are visited after. Vectors that are equal are one
class with one entry, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_runs import key_runs
from ..functions.values import as_number, json_object
from ..session import checked_broadcast
from ..sources.feature_files import MAX_REGISTRY_ROWS

SEED = 41
#: Bits that tell patterns of present coordinates apart; wider vectors have a hash of so many bits.
PATTERN_BITS = 38
#: Vectors with fewer coordinates have no neighbours.
LEAST_PRESENT = 10
#: Neighbours asked for, and the distance beyond which none counts in the join.
NEIGHBOURS, RADIUS = 5, 0.4
#: Projections, and the chance that a neighbour at the bounding distance is seen, in the join.
PROJECTIONS, CONFIDENCE = 6, 0.9999
#: The same in the search without a radius, and its neighbours: few dimensions tell far vectors apart too little.
KNN_PROJECTIONS, KNN_CONFIDENCE, KNN_NEIGHBOURS = 12, 0.99, 10
#: Rows the index's sample holds at most, and rows a cell should hold.
FIT_ROWS, CELL_ROWS = 40_000, 32_768
#: Replaced rows that are broadcast at most (some 40 bytes each).
MOST_REPLACED = 500_000
#: Share of rows that pass the projected test from which on all are verified, by a matrix product.
DENSE_SHARE = 0.03
#: Vectors in a leaf of a cell's own tree.
LEAF_ROWS = 48


def chi_square_quantile(p: float, dof: int) -> float:
    """Inverse of the chi-square distribution for an even number of degrees of freedom."""
    if dof % 2:
        raise ValueError("an even number of projections is needed")

    def upper(x: float) -> float:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return float(np.exp(-x / 2) * total)

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - p else (low, mid)
    return high


def _split(points: np.ndarray, rows: np.ndarray, most: int, depth: int) -> tuple[list, list[np.ndarray]]:
    """kd-tree over rows: nodes (dimension, value, left, right) with leaves as ~number, and the leaves' rows."""
    nodes, leaves = [], []

    def grow(own: np.ndarray, left: int) -> int:
        if len(own) <= most or left == 0:
            leaves.append(own)
            return ~(len(leaves) - 1)
        part = points[own]
        spread = part.max(0) - part.min(0) if len(own) < 512 else np.subtract(*np.quantile(part, (0.9, 0.1), axis=0))
        dim = int(spread.argmax())
        column = part[:, dim]
        if column.max() == column.min():
            leaves.append(own)
            return ~(len(leaves) - 1)
        value = float(np.median(column))
        lower = column < value
        if not lower.any():
            value = float(column[column > value].min())
            lower = column < value
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (dim, value, grow(own[lower], left - 1), grow(own[~lower], left - 1))
        return at

    grow(rows, depth)
    return nodes, leaves


@dataclass
class CellIndex:
    """The trees that cut the projected space of each frequent pattern of present coordinates into cells."""

    scale: np.ndarray
    centre: np.ndarray
    directions: np.ndarray
    trees: dict[int, list]
    by_mask: bool

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Projections of scaled vectors; a missing coordinate counts as the centre."""
        return np.where(np.isnan(vectors), 0.0, (vectors - self.centre) / self.scale) @ self.directions

    def _tree(self, mask: int) -> list:
        return self.trees.get(mask if self.by_mask else 0, [])

    def home(self, masks: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Cell of each point."""
        out = np.zeros(len(points), np.int64)
        group = masks.astype(np.int64) if self.by_mask else np.zeros(len(points), np.int64)
        for mask in np.unique(group):
            own = np.nonzero(group == mask)[0]
            nodes, leaf = self._tree(int(mask)), np.zeros(len(own), np.int64)
            if nodes:
                at = np.zeros(len(own), np.int64)
                dim, value = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
                left, right = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
                while (open_ := at >= 0).any():
                    k = at[open_]
                    at[open_] = np.where(points[own[open_], dim[k]] < value[k], left[k], right[k])
                leaf = ~at
            out[own] = mask << 24 | leaf
        return out

    def reach(self, mask: int, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for the cells of a pattern that lie within each point's radius."""
        nodes = self._tree(mask)
        base = (mask if self.by_mask else 0) << 24
        if not nodes:
            return np.arange(len(points)), np.full(len(points), base, np.int64)
        who, cells = [], []
        stack = [(0, np.arange(len(points)), np.zeros(points.shape))]
        while stack:
            at, own, gap = stack.pop()
            if not len(own):
                continue
            if at < 0:
                who.append(own)
                cells.append(np.full(len(own), base | ~at, np.int64))
                continue
            dim, value, left, right = nodes[at]
            off = points[own, dim] - value
            for side, beyond in ((left, np.maximum(off, 0)), (right, np.maximum(-off, 0))):
                far = gap.copy()
                far[:, dim] = np.maximum(far[:, dim], beyond)
                near = (far**2).sum(1) <= radius[own] ** 2
                stack.append((side, own[near], far[near]))
        return (np.concatenate(who), np.concatenate(cells)) if who else (np.zeros(0, np.int64),) * 2


def fit_index(sample: list[tuple[int, bytes]], total: int, scale: np.ndarray, by_mask: bool, cell_rows: int = CELL_ROWS, projections: int = PROJECTIONS) -> CellIndex:
    """Index from sampled (mask, vector) of `total` vectors; every vector is indexed by it, sampled or not."""
    masks = np.array([m for m, _ in sample], np.int64)
    vectors = _matrix([v for _, v in sample], len(scale))
    with np.errstate(all="ignore"):
        centre = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in vectors.T]) if len(vectors) else np.zeros(len(scale))
    index = CellIndex(scale, centre, np.random.default_rng(SEED).standard_normal((len(scale), projections)), {}, by_mask)
    if not len(vectors):
        return index
    points, group = index.project(vectors), masks if by_mask else np.zeros(len(masks), np.int64)
    for mask, n in zip(*np.unique(group, return_counts=True)):
        depth = int(np.ceil(np.log2(max(1.0, n * total / len(masks) / cell_rows))))
        if depth > 0 and n >= 2:
            index.trees[int(mask)] = _split(points, np.nonzero(group == mask)[0], 1, min(depth, 20))[0]
    return index


def distances(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared distances of aligned rows."""
    apart = (a - b) / scale
    lone = np.isnan(a) != np.isnan(b)
    return np.where(np.isnan(apart), 0.0, apart * apart).sum(1) + lone.sum(1)


class Block:
    """The vectors of one cell under a tree of their projections."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, ranks: np.ndarray, scale: np.ndarray):
        self.nodes, leaves = _split(points, np.arange(len(points)), LEAF_ROWS, 60)
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        sizes = np.array([len(x) for x in leaves])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.vectors, self.points, self.ranks, self.scale = vectors[self.order], points[self.order], ranks[self.order], scale
        self.norms = (self.points**2).sum(1)
        self._right = None
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf where each point would lie."""
        if not self.nodes:
            return np.zeros(len(points), np.int64)
        at = np.zeros(len(points), np.int64)
        dim, value = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])
        left, right = np.array([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes])
        while (open_ := at >= 0).any():
            k = at[open_]
            at[open_] = np.where(points[open_, dim[k]] < value[k], left[k], right[k])
        return ~at

    def search(self, vectors: np.ndarray, points: np.ndarray, selves: np.ndarray, bounds: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance) of the k nearest rows within each query's bound (squared).

        selves: the rank of the row that is the query itself, -1 if none. ratio: the chi-square
        quantile of the stopping test. Rows are numbered as given to the block.
        """
        found = []
        leaf = self.leaf_of(points)
        order = np.argsort(leaf, kind="stable")
        # queries of one leaf go together; where they are sparse, those of neighbouring leaves do
        cuts = np.nonzero(np.diff(leaf[order]))[0] + 1 if len(order) >= 16 * len(self.starts) else []
        for group in np.split(order, cuts) if len(order) else ():
            for at in range(0, len(group), 64):
                found.append(self._search(group[at : at + 64], vectors, points, selves, bounds, k, ratio))
        if not found:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        q, r, d = (np.concatenate(x) for x in zip(*found))
        return q, self.order[r], d

    def _parts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled values with gaps as 0, presence, and the number present: what exact distances are made of."""
        present = ~np.isnan(vectors)
        z = np.where(present, vectors / self.scale, 0.0)
        return z, present.astype(float), present.sum(1).astype(float)

    def _dense(self, left: np.ndarray, n_left: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact squared distances (but for rounding) of all queries and rows, as one matrix product."""
        if self._right is None:
            z, p, n = self._parts(self.vectors)
            self._right, self._n = np.concatenate((p, z * z, z, p), 1), n
        return left @ self._right[rows].T + n_left[:, None] + self._n[rows]

    def _search(self, own, vectors, points, selves, bounds, k, ratio):
        mine, bound = points[own], bounds[own].copy()
        gap = np.maximum(0, np.maximum(self.low - mine.max(0), mine.min(0) - self.high))
        gap = (gap * gap).sum(1)
        near = np.nonzero(gap <= ratio * bound.max())[0]
        near = near[np.argsort(gap[near], kind="stable")]
        norms = (mine * mine).sum(1)
        q, r, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step, left = 0, 4, None
        while at < len(near) and gap[near[at]] <= ratio * bound.max():  # the stopping test: no bound reaches further
            rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in near[at : at + step]])
            at, step = at + step, min(4 * step, 64)
            apart = norms[:, None] + self.norms[rows] - 2 * (mine @ self.points[rows].T)
            passed = apart <= ratio * bound[:, None] + 1e-9 * (1 + norms[:, None])
            if at > 4 and passed.mean() > DENSE_SHARE:
                if left is None:
                    z, p, n_left = self._parts(vectors[own])
                    left = np.concatenate((z * z, p, -2 * z, -2 * p), 1)
                passed = self._dense(left, n_left, rows) <= bound[:, None] * (1 + 1e-9) + 1e-9
            i, j = np.nonzero(passed)
            if not len(i):
                continue
            j = rows[j]
            other = self.ranks[j] != selves[own[i]]
            i, j = i[other], j[other]
            far = distances(vectors[own[i]], self.vectors[j], self.scale)
            ok = far <= bound[i]
            if not ok.any():
                continue
            q, r, d = np.concatenate((q, i[ok])), np.concatenate((r, j[ok])), np.concatenate((d, far[ok]))
            by = np.lexsort((self.ranks[r], d, q))
            q, r, d = q[by], r[by], d[by]
            first = np.searchsorted(q, q)
            place = np.arange(len(q)) - first
            full = q[place == k - 1]
            bound[full] = np.minimum(bound[full], d[place == k - 1])
            keep = place < k
            q, r, d = q[keep], r[keep], d[keep]
        return own[q], r, d


_CLASS = "h1 bigint, h2 bigint, mask bigint, vec binary, keys array<string>"
_CLASS_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("mask", pa.int64()), ("vec", pa.binary()), ("keys", pa.list_(pa.string()))])


def _digest(data: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(data) - (1 << 63), xxhash.xxh64_intdigest(data, 7) - (1 << 63)


def _pattern(present: np.ndarray) -> int:
    """Number of a pattern of present coordinates."""
    if len(present) <= PATTERN_BITS:
        return int((present * (1 << np.arange(len(present)))).sum())
    return xxhash.xxh64_intdigest(present.tobytes()) & ((1 << PATTERN_BITS) - 1)


def _emit_classes(groups: dict[bytes, list[str]], most: int) -> pa.RecordBatch:
    """Per class one row with its `most` smallest keys, and rows without vector for the others."""
    rows = []
    for data, keys in groups.items():
        h1, h2 = _digest(data)
        keys = sorted(set(keys))
        present = ~np.isnan(np.frombuffer(data, np.float64))
        rows.append((h1, h2, _pattern(present), data, keys[:most]))
        rows += [(h1, h2, 0, None, keys[i : i + 1000]) for i in range(most, len(keys), 1000)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CLASS_ARROW)], schema=_CLASS_ARROW)


def in_query_set(key: Column) -> Column:
    """The stated query set: keys whose number is divisible by 50."""
    return F.regexp_extract(key, r"([0-9]+)$", 1).try_cast("bigint") % 50 == 0


def query_classes(k: int) -> Column:
    """Classes that may hold a query: one of their first keys is one, or they have more keys."""
    return F.exists("keys", in_query_set) | (F.size("keys") > k)


def vector_classes(rows: DataFrame, names: dict[str, int], width: int, k: int = NEIGHBOURS, least: int = LEAST_PRESENT) -> DataFrame:
    """(h1, h2, mask, vec, keys) of vectors given as (key, features, numbers).

    features: a JSON object of raw names (names: name -> coordinate), numbers: the coordinates
    themselves, in order of position; one of both is set. Elements beyond the registry's `width`
    positions are no coordinates. NaN, null, infinite and non-numeric coordinates are missing;
    vectors with fewer than `least` are left out. Equal vectors form one class: a row with its
    k + 1 smallest keys, and rows with a null vec for further keys. Copies are gathered where they
    are read, then once more by class, so no class passes through a task as rows of vectors.
    """
    most = k + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[str]] = {}
            for key, text, numbers in zip(*(batch.column(c).to_pylist() for c in ("key", "features", "numbers"))):
                vector = np.full(width, np.nan)
                if numbers is not None:
                    own = [np.nan if v is None else v for v in numbers[:width]]
                    vector[: len(own)] = own
                else:
                    for name, value in (json_object(text) or {}).items():
                        at = names.get(name)
                        if at is not None and vector[at] != vector[at] and (number := as_number(value)) is not None:
                            vector[at] = number
                vector = np.where(np.isfinite(vector), vector + 0.0, np.nan)
                if key is not None and np.isfinite(vector).sum() >= least:
                    groups.setdefault(vector.tobytes(), []).append(key)
            if groups:
                yield _emit_classes(groups, most)

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of classes that occur more than once: one head each, further keys passed on."""
        groups, loose = {}, []
        for row in batch.to_pylist():
            if row["vec"] is None:
                loose.append(tuple(row[c] for c in _CLASS_ARROW.names))
            else:
                groups.setdefault(row["vec"], []).extend(row["keys"])
        if groups:
            yield _emit_classes(groups, most)
        if loose:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*loose), _CLASS_ARROW)], schema=_CLASS_ARROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last class of the rows so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held.cast(_CLASS_ARROW), batch.cast(_CLASS_ARROW)])
            h = batch.column("h1").to_numpy()
            starts = np.concatenate(([0], np.nonzero(h[1:] != h[:-1])[0] + 1))
            held, body = batch.slice(starts[-1]), batch.slice(0, starts[-1])
            alone = np.repeat(np.diff(starts) == 1, np.diff(starts))
            if alone.any():
                yield body.filter(pa.array(alone))
            if not alone.all():
                yield from joined(body.filter(pa.array(~alone)))
            if held.num_rows > 2000:  # a class of very many rows: its heads become one, the rest goes on at once
                parts = list(joined(held))
                heads = pa.concat_batches([p.filter(pa.compute.is_valid(p.column("vec"))) for p in parts])
                for p in parts:
                    if p.column("vec").null_count:
                        yield p.filter(pa.compute.is_null(p.column("vec")))
                held = heads if heads.num_rows else None
        if held is not None:
            yield from joined(held)

    partial = rows.select("key", "features", "numbers").mapInArrow(read, _CLASS)
    return partial.repartition("h1").sortWithinPartitions("h1").mapInArrow(merge, _CLASS)


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), width)


def sample_index(classes: DataFrame, scale: np.ndarray, by_mask: bool, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, projections: int = PROJECTIONS) -> CellIndex:
    """Index fit on about fit_rows vectors (a bound whatever the size of the input), chosen by hash."""
    heads = classes.where("vec IS NOT NULL")
    total = heads.count()
    rate = min(1.0, 0.9 * fit_rows / max(1, total))
    picked = heads.where(F.pmod(F.xxhash64("h2", F.lit(SEED)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("mask", "vec").limit(fit_rows)
    return fit_index([(r[0], bytes(r[1])) for r in picked.collect()], total, scale, by_mask, cell_rows, projections)


_ROW = "cell bigint, role int, h1 bigint, h2 bigint, name string, mask bigint, vec binary, bound double"
_ROW_ARROW = pa.schema([("cell", pa.int64()), ("role", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("name", pa.string()), ("mask", pa.int64()), ("vec", pa.binary()), ("bound", pa.float64())])
_FOUND = "q1 bigint, q2 bigint, h1 bigint, h2 bigint, name string, d2 double"
_FOUND_ARROW = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("name", pa.string()), ("d2", pa.float64())])


def _spread(df: DataFrame) -> int:
    """Tasks of a Python-heavy stage: a fixed number for each core, so that uneven cells even out."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def place(classes: DataFrame, index: CellIndex, asks: Column | None = None) -> DataFrame:
    """Every class with its cell, and role: 1 for queries (all by default), 0 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                cells = index.home(batch.column("mask").to_numpy(), index.project(_matrix(table["vec"].to_pylist(), len(index.scale))))
                n = batch.num_rows
                columns = [pa.array(cells), batch.column("role"), batch.column("h1"), batch.column("h2"), batch.column("name"), batch.column("mask"), batch.column("vec"), pa.nulls(n, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROW_ARROW)

    heads = classes.where("vec IS NOT NULL").select("h1", "h2", F.element_at("keys", 1).alias("name"), "mask", "vec", (F.lit(True) if asks is None else asks).cast("int").alias("role"))
    return heads.mapInArrow(run, _ROW)


def _table(rows: pa.Table, index: CellIndex) -> tuple:
    vectors = _matrix(rows["vec"].to_pylist(), len(index.scale))
    return vectors, index.project(vectors), rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows["name"].to_pylist()


def _ranks(names: list[str]) -> np.ndarray:
    out = np.empty(len(names), np.int64)
    out[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return out


def _found(q1, q2, h1, h2, names, q, r, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q1[q]), pa.array(q2[q]), pa.array(h1[r]), pa.array(h2[r]), pa.array([names[x] for x in r], pa.string()), pa.array(d, pa.float64())], schema=_FOUND_ARROW
    )


_BOTH = f"{_FOUND}, cell bigint, mask bigint, vec binary, bound double"
_BOTH_ARROW = pa.schema([*_FOUND_ARROW, ("cell", pa.int64()), ("mask", pa.int64()), ("vec", pa.binary()), ("bound", pa.float64())])


def search_home(placed: DataFrame, index: CellIndex, k: int, radius: float, ratio: float) -> DataFrame:
    """Neighbours found in the queries' own cells, and (with a cell) the queries that must visit further cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in key_runs(batches, "cell"):
            vectors, points, h1, h2, names = _table(rows, index)
            n, mask = len(names), int(rows["mask"][0].as_py())
            query = np.nonzero(rows["role"].to_numpy() == 1)[0]
            if not len(query) or n == 1 and index.by_mask and not index._tree(mask):
                continue
            ranks, bound = _ranks(names), np.full(len(query), radius * radius)
            if n > 1:
                block = Block(vectors, points, ranks, index.scale)
                q, r, d = block.search(vectors[query], points[query], ranks[query], bound, k, ratio)
                by = np.lexsort((d, q))
                q, r, d = q[by], r[by], d[by]
                kth = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
                bound[q[kth]] = np.minimum(bound[q[kth]], d[kth])
                if len(q):
                    found = _found(h1, h2, h1, h2, names, query[q], r, d)
                    yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(len(q), f.type) for f in list(_BOTH_ARROW)[6:])], schema=_BOTH_ARROW)
            who, cells = index.reach(mask, points[query], np.sqrt(ratio * bound))
            away = cells != cell
            who, cells = who[away], cells[away]
            for at in range(0, len(who), 20_000):
                w = who[at : at + 20_000]
                g = query[w]
                part = rows.take(pa.array(g))
                columns = [pa.array(h1[g]), pa.array(h2[g]), pa.nulls(len(g), pa.int64()), pa.nulls(len(g), pa.int64()), part["name"].combine_chunks(), pa.nulls(len(g), pa.float64()), pa.array(cells[at : at + 20_000]), part["mask"].combine_chunks(), part["vec"].combine_chunks(), pa.array(bound[w])]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_BOTH_ARROW)

    return placed.repartition(_spread(placed), "cell").sortWithinPartitions("cell").mapInArrow(run, _BOTH)


def search_away(placed: DataFrame, visits: DataFrame, index: CellIndex, k: int, ratio: float) -> DataFrame:
    """Neighbours that visiting queries (h1, h2, name, cell, mask, vec, bound) find in other cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in key_runs(batches, "cell"):
            role = rows["role"].to_numpy()
            own, guests = rows.filter(pa.array(role < 2)), rows.filter(pa.array(role == 2))
            if not own.num_rows or not guests.num_rows:
                continue
            vectors, points, h1, h2, names = _table(own, index)
            block = Block(vectors, points, _ranks(names), index.scale)
            for at in range(0, guests.num_rows, 50_000):
                part = guests.slice(at, 50_000)
                gv, gp, g1, g2, _ = _table(part, index)
                q, r, d = block.search(gv, gp, np.full(len(gv), -1), part["bound"].to_numpy(), k, ratio)
                if len(q):
                    yield _found(g1, g2, h1, h2, names, q, r, d)

    guests = visits.select("cell", F.lit(2).alias("role"), "h1", "h2", "name", "mask", "vec", "bound")
    both = placed.unionByName(guests)
    return both.repartition(_spread(placed), "cell").sortWithinPartitions("cell", "role").mapInArrow(run, _FOUND)


def class_neighbours(classes: DataFrame, index: CellIndex, settle, k: int = NEIGHBOURS, radius: float = RADIUS, confidence: float = CONFIDENCE, asks: Column | None = None) -> DataFrame:
    """(q1, q2, h1, h2, d2): the k nearest other classes within the radius of every class, or of those that asks (over keys) picks."""
    ratio = chi_square_quantile(confidence, index.directions.shape[1])
    placed = place(classes, index, asks)
    first = settle(search_home(placed, index, k, radius, ratio))
    visits = first.where("cell IS NOT NULL").select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "name", "cell", "mask", "vec", "bound")
    found = first.where("cell IS NULL").select("q1", "q2", "h1", "h2", "name", "d2").unionByName(search_away(placed, visits, index, k, ratio))
    nearest = Window.partitionBy("q1", "q2").orderBy("d2", "name")
    return found.withColumn("__n", F.row_number().over(nearest)).where(F.col("__n") <= k).drop("__n", "name")


def member_neighbours(classes: DataFrame, near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(key, neighbour, d2): the k nearest vectors of every vector, equal distances by the smaller key.

    A class's list holds its own k + 1 smallest keys (at distance 0) and the k smallest of each
    near class; each member takes the first k that are not itself. Lists are bounded by k.
    """
    heads = classes.where("vec IS NOT NULL").select("h1", "h2", "keys")
    others = near.join(heads, ["h1", "h2"]).select("q1", "q2", F.explode(F.transform(F.slice("keys", 1, k), lambda x: F.struct(F.col("d2").alias("d2"), x.alias("key")))).alias("n"))
    lists = others.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("others"))
    own = heads.join(lists.withColumnsRenamed({"q1": "h1", "q2": "h2"}), ["h1", "h2"], "left")
    itself = F.transform("keys", lambda x: F.struct(F.lit(0.0).alias("d2"), x.alias("key")))
    full = own.select("h1", "h2", "keys", F.slice(F.array_sort(F.concat(itself, F.coalesce("others", F.expr("cast(array() as array<struct<d2:double,key:string>>)")))), 1, k + 1).alias("list"))
    # the further members of large classes look their class's list up
    loose = classes.where("vec IS NULL").select("h1", "h2", F.explode("keys").alias("key"))
    members = full.select(F.explode("keys").alias("key"), "list").unionByName(loose.join(full.select("h1", "h2", "list"), ["h1", "h2"]).select("key", "list"))
    picked = members.select("key", F.explode(F.slice(F.filter("list", lambda n: n["key"] != F.col("key")), 1, k)).alias("n"))
    return picked.select("key", F.col("n.key").alias("neighbour"), F.col("n.d2").alias("d2"))


def near_pairs(members: DataFrame) -> DataFrame:
    """(key_a, key_b), the smaller first: pairs of which one is among the nearest of the other."""
    return members.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def latest_fingerprints(fingerprints: DataFrame, settle) -> DataFrame:
    """The rows of each request_id with the latest created_utc (equal ones: the highest hash, then text).

    Only the order is shuffled; the few rows that another replaces are stored by settle(df) and left
    out of the scan of the texts. Rows equal in everything stay and count as one later.
    """
    rows = fingerprints.where("request_id IS NOT NULL").select("request_id", "created_utc", "feature_hash", "features_json")
    marked = rows.withColumn("__row", F.xxhash64("request_id", "created_utc", "feature_hash", "features_json"))
    newest = Window.partitionBy("request_id").orderBy(F.col("created_utc").desc_nulls_last(), F.col("feature_hash").desc_nulls_last(), "__row")
    replaced = marked.select("request_id", "created_utc", "feature_hash", "__row").withColumn("__n", F.dense_rank().over(newest)).where("__n > 1").select("request_id", "__row")
    return marked.join(checked_broadcast(settle(replaced), MOST_REPLACED), ["request_id", "__row"], "left_anti")


def account_vectors(fingerprints: DataFrame, cohort: DataFrame, twins: DataFrame, settle) -> DataFrame:
    """(key, features, numbers) of the three tables' vectors; of a request_id only the row with the latest created_utc."""
    none = F.lit(None)
    latest = latest_fingerprints(fingerprints, settle)
    return (
        latest.select(F.col("request_id").alias("key"), F.col("features_json").alias("features"), none.cast("array<double>").alias("numbers"))
        .unionByName(cohort.select(F.col("reference").alias("key"), none.cast("string").alias("features"), F.col("numeric_values").cast("array<double>").alias("numbers")))
        .unionByName(twins.select(F.col("row_label").alias("key"), none.cast("string").alias("features"), F.col("x_values").cast("array<double>").alias("numbers")))
    )


def coordinates(registry: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Names of the vectors' coordinates (features and variable names) and the scale of every position.

    The registry is a fixed, small table: one of more than MAX_REGISTRY_ROWS positions is refused. A
    position that no row has, or whose scale is null, counts with scale 1.
    """
    rows = registry.where("vec_pos IS NOT NULL").select("vec_pos", "feature", "variable_name", "vec_scale").orderBy("vec_pos", "feature").limit(MAX_REGISTRY_ROWS + 1).collect()
    if len(rows) > MAX_REGISTRY_ROWS:
        raise ValueError(f"a registry of more than {MAX_REGISTRY_ROWS} positions")
    names, scale = {}, np.ones(max((r[0] for r in rows), default=-1) + 1)
    for at, feature, variable, size in rows:
        names |= {name: at for name in (feature, variable) if name is not None}
        scale[at] = 1.0 if size is None else size
    return names, scale
