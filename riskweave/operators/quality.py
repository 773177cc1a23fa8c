"""Column-level data quality of feature files (problem 5).

Checks are declared per column from the registry and compiled into one scan: every
worker keeps, for each file and column it meets, one state that all checks share
(values present, faults, values out of bounds, and the distinct numbers). A file that
one worker reads whole is closed there: its metrics, of a fixed size, take the place
of the values. States of files that lie in several partitions or loads merge by
addition, in any order, so a stored load never has to be read again. Every check
compares a metric with limits: fixed ones, or control limits from the source's
history - its previous file, or up to HISTORY_FILES files.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_number, is_missing, json_object, plain_name
from ..sources.feature_files import NUMBER_KINDS, TEXT_KINDS, Feature, counted_lines, file_sequence, names_of
from .quantiles import linear_quantiles, value_counts

#: Limits of the issues (fixed values); they are exceeded if by more than SLACK.
NULL_RATE_CHANGE, LEAST_NUMBERS, SLACK = 0.30, 10, 1e-7
#: Lines of a file from which on its columns' values are ranked in pieces.
LARGE_FILE = 5_000_000
#: Files whose sizes are broadcast at most (16 bytes each), so that workers know which files they have read whole.
MOST_FILES = 2_000_000
#: Values a worker holds before it passes its states on.
WORKER_VALUES = 2_000_000
#: Control limits: so many files of history at most and at least, and so many standard deviations.
HISTORY_FILES, LEAST_HISTORY, SIGMAS = 20, 5, 3.0

_POINTS = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "high": 1.0}
_COUNTS = ("n_lines", "n_valued", "n_fault", "n_outside")
_METRICS = pa.schema([("file_id", pa.int64()), ("feature", pa.int32()), *((c, pa.int64()) for c in (*_COUNTS, "n_numbers", "n_distinct")), *((c, pa.float64()) for c in _POINTS)])
#: A state is open while it has its values (held), and closed when it has metrics instead.
_STATE = pa.schema([*_METRICS, ("held", pa.binary())])
_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


class _State:
    """What all checks of one file's column share."""

    __slots__ = ("n_valued", "n_fault", "n_outside", "held")

    def __init__(self, numeric: bool):
        self.n_valued = self.n_fault = self.n_outside = 0
        self.held = array("d") if numeric else set()

    def blob(self) -> bytes:
        """The numbers, or the digests of the distinct values."""
        return (self.held if type(self.held) is array else array("q", self.held)).tobytes()


def compile_checks(registry: list[Feature]) -> list:
    """For each column a function (state, value) that takes in a value that is not missing."""

    def numeric(low: float | None, high: float | None):
        low = float("-inf") if low is None else low - SLACK
        high = float("inf") if high is None else high + SLACK

        def take(state: _State, value) -> None:
            state.n_valued += 1
            number = value if type(value) is float else as_number(value)
            if number is None:
                state.n_fault += 1
                return
            if not low <= number <= high:
                state.n_outside += 1
            state.held.append(number + 0.0)

        return take

    def text(pattern: str | None):
        whole = re.compile(pattern).fullmatch if pattern else None

        def take(state: _State, value) -> None:
            state.n_valued += 1
            if whole and not (type(value) is str and whole(value)):
                state.n_fault += 1
            state.held.add(_digest(value))

        return take

    def flag(state: _State, value) -> None:
        state.n_valued += 1
        state.held.add(_digest(value))

    return [numeric(f.lo_bound, f.hi_bound) if f.value_kind in NUMBER_KINDS else text(f.value_pattern) if f.value_kind in TEXT_KINDS else flag for f in registry]


def _digest(value) -> int:
    """64 bits of a value, the same in every process: numbers by value, the rest by text."""
    number = as_number(value)
    return xxhash.xxh64_intdigest(repr(number) if number is not None else str(value).strip()) - (1 << 63)


def _measure(states: pa.Table, numeric: np.ndarray) -> pa.RecordBatch:
    """Metrics of states that are sorted by file and column; states of one key are added. Percentiles by linear interpolation."""
    file, feature = states["file_id"].to_numpy(), states["feature"].to_numpy()
    starts = np.nonzero(np.concatenate(([True], (file[1:] != file[:-1]) | (feature[1:] != feature[:-1]))))[0]
    sums = [np.add.reduceat(states[c].to_numpy(), starts) for c in _COUNTS]
    blobs = states["held"].to_pylist()
    size = np.add.reduceat(np.array([len(b) // 8 for b in blobs], np.int64), starts)
    raw = np.frombuffer(b"".join(blobs), np.int64)
    group = np.repeat(np.arange(len(starts)), size)
    is_number = numeric[feature[starts]]
    n_distinct = np.zeros(len(starts), np.int64)
    own = ~is_number[group]
    if own.any():
        g, v = group[own], raw[own]
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        np.add.at(n_distinct, g, np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]))))
    count = np.where(is_number, size, 0)
    points = {c: np.full(len(starts), np.nan) for c in _POINTS}
    if count.any():
        g, v = group[~own], raw.view(np.float64)[~own]
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        np.add.at(n_distinct, g, np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1]))))
        has = np.nonzero(count)[0]
        begin, last = np.concatenate(([0], np.cumsum(count)[:-1]))[has], count[has] - 1
        for c, q in _POINTS.items():
            at = q * last
            low = np.floor(at).astype(np.int64)
            a, b = v[begin + low], v[begin + np.minimum(low + 1, last)]
            with np.errstate(invalid="ignore"):
                points[c][has] = np.where(a == b, a, a + (b - a) * (at - low))
    empty = pa.array(count == 0)
    cut = [pc.if_else(empty, pa.scalar(None, pa.float64()), pa.array(points[c])) for c in points]
    arrays = [pa.array(file[starts]), pa.array(feature[starts]), *map(pa.array, sums), pa.array(count), pa.array(n_distinct), *cut]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _METRICS)], schema=_METRICS)


def scan_states(lines: DataFrame, registry: list[Feature], sizes: DataFrame | None = None) -> DataFrame:
    """Partial states (file_id, feature, n_lines, ..., held); feature -1 holds the file's number of lines.

    Lines that are not one complete JSON object are left out. An open state has the column's values in
    `held` (for codes, dates and flags the digests of the distinct ones), 8 bytes each. sizes: (file_id,
    n_rows), how many of the lines each file has; states of a file of which a worker has read so many
    are closed: `held` is null and the metrics are set.
    """
    names, kinds = names_of(registry), [f.value_kind in NUMBER_KINDS for f in registry]
    numeric = np.array([*kinds, False])
    n_counts = len(_COUNTS)

    def emit(states: dict, sizes: dict, whole: set) -> Iterator[pa.RecordBatch]:
        rows = [(file, -1, n, 0, 0, 0, b"") for file, n in sizes.items()]
        rows += [(file, at, 0, s.n_valued, s.n_fault, s.n_outside, s.blob()) for (file, at), s in states.items()]
        fields = [_STATE.field(c) for c in ("file_id", "feature", *_COUNTS, "held")]
        rows.sort(key=lambda r: r[:2])
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            if closed := [r for r in part if r[0] in whole]:
                done = _measure(pa.table([pa.array(c, f.type) for c, f in zip(zip(*closed), fields)], schema=pa.schema(fields)), numeric)
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(done.num_rows, pa.binary())], schema=_STATE)
            if open_ := [r for r in part if r[0] not in whole]:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*open_), fields)]
                gaps = [pa.nulls(len(open_), f.type) for f in list(_METRICS)[2 + n_counts :]]
                yield pa.RecordBatch.from_arrays([*columns[:-1], *gaps, columns[-1]], schema=_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks, place = compile_checks(registry), {}
        states, counted, read, want, held = {}, {}, {}, {}, 0
        for batch in batches:
            for file, text, n_rows in zip(*(batch.column(c).to_pylist() for c in ("file_id", "features", "n_rows"))):
                read[file] = read.get(file, 0) + 1
                want[file] = n_rows
                found = json_object(text)
                if found is None:
                    continue
                counted[file] = counted.get(file, 0) + 1
                held += len(found)
                seen = {}
                for field, value in found.items():
                    at = place.get(field)
                    if at is None:
                        if len(place) > 100_000:
                            place.clear()
                        at = place[field] = names.get(plain_name(field), -1)
                    if at < 0:
                        continue
                    if (state := states.get((file, at))) is None:
                        state = states[file, at] = _State(kinds[at])
                    if type(value) is not float and is_missing(value):
                        continue
                    if at in seen:  # a second name of the same feature in this line: the first value counts
                        continue
                    seen[at] = True
                    checks[at](state, value)
            if held > WORKER_VALUES:
                yield from emit(states, counted, {f for f, n in read.items() if n == want[f]})
                states, counted, read, held = {}, {}, {}, 0
        if counted:
            yield from emit(states, counted, {f for f, n in read.items() if n == want[f]})

    plain = lines.select("file_id", "features")
    told = plain.withColumn("n_rows", F.lit(-1).cast("bigint")) if sizes is None else plain.join(F.broadcast(sizes), "file_id", "left")  # callers bound the sizes
    return told.select("file_id", "features", "n_rows").mapInArrow(run, _ddl(_STATE))


def merge_states(states: DataFrame, registry: list[Feature]) -> DataFrame:
    """(file_id, feature, metrics...) of every file's column: open states of one key stream in sorted order and are added.

    Percentiles are exact (linear interpolation): the values of one column of one file are held in
    memory at a time, 8 bytes a line. For files of more than LARGE_FILE lines see `merge_large_states`.
    """
    numeric = np.array([f.value_kind in NUMBER_KINDS for f in registry] + [False])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            file, feature = (batch.column(c).to_numpy() for c in ("file_id", "feature"))
            cut = int(np.nonzero((file == file[-1]) & (feature == feature[-1]))[0][0])
            if cut:  # all but the last key is complete
                table = pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)]).combine_chunks()
                kept = [batch.slice(cut)]
                yield _measure(table, numeric)
            elif len(kept) > 1:
                previous = kept[-2]
                if (previous.column("file_id")[-1], previous.column("feature")[-1]) != (batch.column("file_id")[0], batch.column("feature")[0]):
                    table = pa.Table.from_batches(kept[:-1]).combine_chunks()
                    kept = [batch]
                    yield _measure(table, numeric)
        if kept:
            yield _measure(pa.Table.from_batches(kept).combine_chunks(), numeric)

    keyed = states.select("file_id", "feature", *_COUNTS, "held").repartition("file_id", "feature").sortWithinPartitions("file_id", "feature")
    return keyed.mapInArrow(run, _ddl(_METRICS))


def merge_large_states(states: DataFrame, registry: list[Feature]) -> DataFrame:
    """The same metrics, also exact, for files of any size: values are counted and ranked in pieces, none is gathered."""
    numeric = np.array([f.value_kind in NUMBER_KINDS for f in registry] + [False])
    schema = pa.schema([("file_id", pa.int64()), ("feature", pa.int32()), ("value", pa.float64()), ("bits", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, feature, held in zip(*(batch.column(c).to_pylist() for c in ("file_id", "feature", "held"))):
                bits = np.frombuffer(held, np.int64)
                for at in range(0, len(bits), 100_000):
                    part = bits[at : at + 100_000]
                    value = pa.array(part.view(np.float64)) if numeric[feature] else pa.nulls(len(part), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), file)), pa.array(np.full(len(part), feature, np.int32)), value, pa.array(part)], schema=schema)

    keys = ["file_id", "feature"]
    values = states.select(*keys, "held").mapInArrow(unpack, "file_id bigint, feature int, value double, bits bigint")
    sums = states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_lines", "n_valued", "n_fault", "n_outside")))
    distinct = values.select(*keys, "bits").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    counts = value_counts(values, keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n_numbers"))
    points = linear_quantiles(counts, keys, {"low": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "high": 1.0})
    zero = F.lit(0).cast("bigint")
    joined = sums.join(distinct, keys, "left").join(sizes, keys, "left").join(points, keys, "left")
    return joined.select(*(F.coalesce(f.name, zero).alias(f.name) if f.name in ("n_numbers", "n_distinct") else F.col(f.name) for f in _METRICS))


def load_states(lines: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """The stored states of one load, all open: those of several loads, put together by union, are what `metrics_of` takes.

    A file may come in several loads; a (file_id, line_no) in one only.
    """
    return settle(scan_states(counted_lines(lines, settle), registry))


def metrics_of(states: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """Metrics of all files from stored states: closed ones as they are, open ones merged; files of more than LARGE_FILE lines the way that gathers nothing."""
    closed = states.where("held IS NULL").select(*_METRICS.names)
    open_ = states.where("held IS NOT NULL")
    large = settle(open_.where("feature < 0").groupBy("file_id").agg(F.sum("n_lines").alias("n")).where(F.col("n") > LARGE_FILE).select("file_id"))
    if large.isEmpty():
        return closed.unionByName(settle(merge_states(open_, registry)))
    small = settle(merge_states(open_.join(large, "file_id", "left_anti"), registry))
    return closed.unionByName(small).unionByName(settle(merge_large_states(open_.join(large, "file_id", "left_semi"), registry)))


def file_metrics(lines: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """Metrics of all files of one scan."""
    counted = counted_lines(lines, settle)
    sizes = settle(counted.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")))
    fits = sizes.limit(MOST_FILES + 1).count() <= MOST_FILES  # beyond it all states stay open and are merged
    return metrics_of(settle(scan_states(counted, registry, sizes if fits else None)), registry, settle)


def _registry_table(spark, registry: list[Feature]) -> DataFrame:
    rows = [(i, f.feature, f.value_kind) for i, f in enumerate(registry)]
    return spark.createDataFrame(rows, "feature int, column_name string, value_kind string")


def file_profile(lines: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """One row per file and registry feature in it: metrics, and those of the source's previous file (prev_*).

    lines: (line_id, file_id, source_name, file_seq, line_no, features). missing_share counts lines
    without a value. Columns without numbers have null percentiles; a feature that no line of a
    file names has no row; an empty table has none. settle(df) stores rows used more than once.
    """
    return profile_of(file_metrics(lines, registry, settle), settle(file_sequence(lines)), registry)


def profile_of(merged: DataFrame, files: DataFrame, registry: list[Feature]) -> DataFrame:
    """`file_profile` from metrics and the sequence of files."""
    sizes = merged.where("feature < 0").select("file_id", "n_lines")
    own = merged.where("feature >= 0").drop("n_lines").join(sizes, "file_id")
    measured = own.withColumn("missing_share", 1 - F.col("n_valued") / F.col("n_lines"))
    named = measured.join(_registry_table(files.sparkSession, registry), "feature").join(files.drop("n_rows"), "file_id")
    before = measured.select(
        F.col("file_id").alias("prev_file_id"), "feature", *(F.col(c).alias(f"prev_{c}") for c in ("missing_share", "n_numbers", "p10", "p50", "p90"))
    )
    return named.join(before, ["prev_file_id", "feature"], "left").select(
        "file_id", "source_name", "file_seq", "prev_file_id", "column_name", "value_kind", "n_lines", "missing_share", "n_distinct", "n_fault", "n_outside", "n_numbers",
        "low", "p10", "p50", "p90", "high", "prev_missing_share", "prev_n_numbers", "prev_p10", "prev_p50", "prev_p90",
    )


def _limited(issue: str, value: Column, low: Column | float | None, high: Column | float | None, applies: Column | None = None) -> Column:
    """A check: the metric's value and the limits it must lie within; null where the check doesn't apply."""
    cast = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    cell = F.struct(F.lit(issue).alias("issue"), cast(value).alias("value"), cast(low).alias("low"), cast(high).alias("high"))
    return cell if applies is None else F.when(applies, cell)


def _outside(checks: list[Column]) -> Column:
    """The checks whose value is outside its limits by more than SLACK, one row each."""
    beyond = lambda c: F.coalesce(c["value"] < c["low"] - SLACK, F.lit(False)) | F.coalesce(c["value"] > c["high"] + SLACK, F.lit(False))
    return F.explode(F.filter(F.array_compact(F.array(*checks)), beyond))


def limit_violations(profile: DataFrame) -> DataFrame:
    """(file_id, column_name, issue, value, low, high) of the metrics of a `file_profile` that are outside their limits.

    The limits of null_rate and shift are control limits from the source's previous file, the others fixed.
    """
    number = F.col("value_kind").isin(*NUMBER_KINDS)
    enough = number & (F.col("n_numbers") >= LEAST_NUMBERS)
    before = F.col("prev_missing_share")
    checks = [
        _limited("null_rate", F.col("missing_share"), before - NULL_RATE_CHANGE, before + NULL_RATE_CHANGE),
        _limited("range", F.col("n_outside"), None, 0, number),
        _limited("constant", (F.col("low") == F.col("high")).cast("int"), None, 0, enough),
        _limited("pattern", F.col("n_fault"), None, 0, F.col("value_kind").isin(*NUMBER_KINDS, *TEXT_KINDS)),
        _limited("shift", F.col("p50"), F.col("prev_p10"), F.col("prev_p90"), enough & (F.col("prev_n_numbers") >= LEAST_NUMBERS)),
    ]
    return profile.select("file_id", "column_name", _outside(checks).alias("c")).select("file_id", "column_name", "c.*")


def column_issues(profile: DataFrame) -> DataFrame:
    """(file_id, column_name, issue) of a `file_profile`."""
    return limit_violations(profile).select("file_id", "column_name", "issue")


def dry_run_issues(dry_runs: DataFrame, registry: list[Feature]) -> DataFrame:
    """(file_id, column_name, issue) of the dry runs' two figures: null, or outside what is possible."""
    figures = {"n_missing_required": float(sum(f.is_required for f in registry)), "schema_completeness": 1.0}
    rows = None
    for name, most in figures.items():
        value = F.col(name).cast("double")
        given = value.isNotNull() & ~F.isnan(value)
        checks = [_limited("null_rate", (~given).cast("int"), None, 0), _limited("range", value, 0.0, most, given)]
        part = dry_runs.where("file_id IS NOT NULL").select("file_id", F.lit(name).alias("column_name"), _outside(checks).alias("c")).select("file_id", "column_name", "c.issue")
        rows = part if rows is None else rows.union(part)
    return rows


def control_limits(profile: DataFrame) -> DataFrame:
    """(file_id, column_name, metric, value, mean, sd): metrics outside SIGMAS deviations of their source's history.

    The history of a file are the up to HISTORY_FILES files of its source before it, LEAST_HISTORY
    at least; a constant history flags any other value. One row a file and column is sorted, never
    the values.
    """
    metrics = ("missing_share", "p50", "n_distinct")
    long = profile.select("file_id", "source_name", "file_seq", "column_name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("*", "m.*").drop("m").where("value IS NOT NULL")
    before = Window.partitionBy("source_name", "column_name", "metric").orderBy("file_seq", "file_id").rowsBetween(-HISTORY_FILES, -1)
    judged = long.select("file_id", "column_name", "metric", "value", F.count("value").over(before).alias("n"), F.avg("value").over(before).alias("mean"), F.stddev_samp("value").over(before).alias("sd"))
    return judged.where((F.col("n") >= LEAST_HISTORY) & (F.abs(F.col("value") - F.col("mean")) > SIGMAS * F.col("sd") + SLACK)).drop("n")
