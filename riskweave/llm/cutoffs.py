"""Score cutoffs that keep a target size or fraction (problem 2).

Scores are integer-coded on a grid of 2**BITS leaves. A batch (a day's arrivals) is
turned into the counts of its dyadic nodes, root to leaves, one stored row a key and
batch; a row that a later one replaces is taken off in the batch of its successor.
Adding a batch appends its rows: what is stored is never rewritten, and the tree as
of a batch is the sum of the node counts up to it. A target rank is found by
descending from the root: into the upper half if it alone holds more than fits,
else past it into the lower half. The leaf where the descent ends is refined to its
distinct scores, so the cutoff is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import number_within, plain_source, plain_tier

#: Resolution of the tree: 65,536 leaves (131,071 nodes) bound what one key's tree takes.
BITS = 16
#: Batch of rows whose arrival is not known: the first of all.
FIRST_BATCH = "1970-01-01"


def leaf_code(score: Column, low: float = 0.0, high: float = 1.0, bits: int = BITS) -> Column:
    """Leaf of a score of low..high; monotone."""
    return F.least(F.floor((score - low) / (high - low) * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("int")


def score_counts(events: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, batch, score, n): events of equal keys, batch and score, added up before the shuffle.

    events: keys, score, and if they have them `batch` (a date) and `n` (1 by default, -1 for a row that is
    taken back).
    """
    batch = F.col("batch") if "batch" in events.columns else F.lit(FIRST_BATCH).cast("date")
    n = F.col("n").cast("bigint") if "n" in events.columns else F.lit(1).cast("bigint")
    rows = events.select(*keys, batch.alias("batch"), score, n.alias("n"))
    return rows.groupBy(*keys, "batch", score).agg(F.sum("n").alias("n")).where("n <> 0")


_NAMES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32()}


def _key_schema(df: DataFrame, keys: list[str]) -> tuple[str, list[pa.Field]]:
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    return "".join(f"`{k}` {kinds[k]}, " for k in keys), [pa.field(k, _NAMES[kinds[k]]) for k in keys]


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows where a key (nulls are equal) differs from the row before; the first is one."""
    new = np.zeros(batch.num_rows, bool)
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return np.nonzero(new)[0]


def _all_nodes(owner: np.ndarray, leaves: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, node, count) of every level above and at the leaves; rows are sorted by owner and leaf. Nodes are heap-numbered: 1 is the root."""
    parts = []
    at, n = leaves + (1 << bits), counts
    for level in range(bits + 1):
        if level:
            at = at >> 1
        cut = np.nonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]))))[0]
        owner, at, n = owner[cut], at[cut], np.add.reduceat(n, cut)
        parts.append((owner, at, n))
    owner, at, n = (np.concatenate(x[::-1]) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return owner[order], at[order], n[order]


def batch_nodes(counts: DataFrame, keys: list[str], score: str, low: float = 0.0, high: float = 1.0, bits: int = BITS) -> DataFrame:
    """(keys, batch, nodes, counts): the dyadic node counts of every key and batch, to be stored.

    A row holds the nodes of one key and batch, 2 ** (bits + 1) - 1 at most; leaf counts stream through
    sorted partitions, so no key's scores are gathered.
    """
    by = [*keys, "batch"]
    leaves = counts.groupBy(*by, leaf_code(F.col(score), low, high, bits).alias("leaf")).agg(F.sum("n").alias("n"))
    spark_keys, fields = _key_schema(leaves, by)
    schema = pa.schema([*fields, pa.field("nodes", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.int64()))])

    def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
        starts = _starts(rows, by)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        own, node, n = _all_nodes(owner, rows.column("leaf").to_numpy().astype(np.int64), rows.column("n").to_numpy(), bits)
        offsets = pa.array(np.searchsorted(own, np.arange(len(starts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(node, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(starts)) for k in by), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            cut = int(_starts(batch, by)[-1])  # all but the last key and batch is complete
            if cut:
                yield emit(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield emit(held)

    ordered = leaves.repartition(*by).sortWithinPartitions(*by, "leaf")
    return ordered.mapInArrow(run, f"{spark_keys}nodes array<int>, counts array<bigint>")


def add_batch(tree: DataFrame, batch: DataFrame) -> DataFrame:
    """The tree after a batch: its node counts stand beside those before it."""
    return tree.unionByName(batch)


def as_of(tree: DataFrame, batch: Column) -> DataFrame:
    """The tree (or the counts) as it was after a batch."""
    return tree.where(F.col("batch") <= batch)


def _descend(count: np.ndarray, target: int, bits: int) -> tuple[int, int]:
    """The leaf where the target rank falls, and how many records lie above that leaf; count is heap-numbered."""
    if count[1] <= target:
        return -1, int(count[1])  # everything is kept
    node, above = 1, 0
    for _ in range(bits):
        upper = int(count[2 * node + 1])
        if above + upper > target:
            node = 2 * node + 1
        else:
            above, node = above + upper, 2 * node
    return node - (1 << bits), above


def descend_to_targets(tree: DataFrame, targets: DataFrame, keys: list[str], target: str, bits: int = BITS) -> DataFrame:
    """(keys, target, cut_leaf, n_above, n_records) for the keys that occur in both inputs.

    targets has one row a key. cut_leaf is -1 where all records fit. The batches of a key stream into
    one array of nodes, whose size is bounded; keys come one after the other.
    """
    joined = tree.join(targets.select(*keys, F.col(target).cast("bigint").alias("__target")), keys)
    spark_keys, fields = _key_schema(joined, keys)
    figures = ("target", "cut_leaf", "n_above", "n_records")
    schema = pa.schema([*fields, *(pa.field(c, pa.int64()) for c in figures)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, touched, now, done = np.zeros(2 << bits, np.int64), [], None, []

        def finish() -> None:
            if touched and count[1] > 0:
                done.append((*now, *_descend(count, now[-1], bits), int(count[1])))
            for nodes in touched:
                count[nodes] = 0
            touched.clear()

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "__target"))))
            nodes, sums = batch.column("nodes"), batch.column("counts")
            for i, name in enumerate(names):
                if name != now:
                    finish()
                    now = name
                own = nodes[i].values.to_numpy()
                count[own] += sums[i].values.to_numpy()  # nodes of one row are distinct
                touched.append(own)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    ordered = joined.select(*keys, "__target", "nodes", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, f"{spark_keys}{', '.join(f'{c} bigint' for c in figures)}")


def exact_cutoffs(
    counts: DataFrame, tree: DataFrame, targets: DataFrame, keys: list[str], score: str, target: str, settle: Callable[[DataFrame], DataFrame], low: float = 0.0, high: float = 1.0, bits: int = BITS
) -> DataFrame:
    """(keys, target, cut_leaf, leaf_cutoff, n_records): the lowest cutoff that keeps no more than target.

    A record is kept if its leaf is above cut_leaf, or it lies in cut_leaf and its score is
    leaf_cutoff or more (null: no score of that leaf fits). counts comes from `score_counts`, tree from
    `batch_nodes` of the same batches. Ties are kept or left together. settle(df) stores the ends of the
    descents, one row a key.
    """
    ends = settle(descend_to_targets(tree, targets, keys, target, bits))
    code = leaf_code(F.col(score), low, high, bits)
    inside = counts.join(ends, keys).where(code == F.col("cut_leaf")).groupBy(*keys, score, "target", "n_above").agg(F.sum("n").alias("n")).where("n > 0")
    upto = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("__kept", F.col("n_above") + F.sum("n").over(upto)).where("__kept <= target")
    refined = fits.groupBy(*keys).agg(F.min(score).alias("leaf_cutoff"))
    return ends.join(refined, keys, "left").select(*keys, "target", "cut_leaf", "leaf_cutoff", "n_records")


def kept(records: DataFrame, cutoffs: DataFrame, keys: list[str], score: str, low: float = 0.0, high: float = 1.0, bits: int = BITS) -> DataFrame:
    """The records at or above their key's cutoff, with the cutoffs' columns."""
    code = leaf_code(F.col(score), low, high, bits)
    above = (code > F.col("cut_leaf")) | ((code == F.col("cut_leaf")) & (F.col(score) >= F.col("leaf_cutoff")))
    return records.join(cutoffs, keys).where(above)


def scored_rows(scores: DataFrame, *extra: str) -> DataFrame:
    """(id, source_name, screen_date, calibrated_risk, batch, replaced_in, extra...): every valid row, and since when it counts no more.

    batch is the day of created_utc (FIRST_BATCH if null), replaced_in that of the next row of its
    request_id in order of created_utc, then id: null for the latest. Rows whose calibrated_risk is no
    number of 0..1 are left out, but do replace the rows before them. Rows without a request_id count
    each for itself.
    """
    request = F.coalesce("request_id", F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    newest = Window.partitionBy("__request").orderBy(F.col("created_utc").desc_nulls_last(), F.col("id").desc())
    batch = F.coalesce(F.to_date("created_utc"), F.lit(FIRST_BATCH).cast("date"))
    rows = scores.select("id", request.alias("__request"), "created_utc", plain_source("source_name").alias("source_name"), "screen_date", "calibrated_risk", batch.alias("batch"), *extra)
    followed = rows.withColumn("replaced_in", F.lag("batch").over(newest))
    valid = number_within("calibrated_risk", 0.0, 1.0)
    # -0.0 and 0.0 are one score
    return followed.where(valid.isNotNull()).select("id", "source_name", "screen_date", (F.col("calibrated_risk") + F.lit(0.0)).alias("calibrated_risk"), "batch", "replaced_in", *extra)


def latest(rows: DataFrame) -> DataFrame:
    """The rows of `scored_rows` that count now: of a request_id the one with the latest created_utc, then the highest id, if it is valid."""
    return rows.where("replaced_in IS NULL")


def score_events(rows: DataFrame) -> DataFrame:
    """(source_name, screen_date, calibrated_risk, batch, n) of `scored_rows`: 1 in a row's batch, -1 in the batch that replaces it."""
    added = F.struct(F.col("batch"), F.lit(1).alias("n"))
    taken = F.when(F.col("replaced_in").isNotNull(), F.struct(F.col("replaced_in").alias("batch"), F.lit(-1).alias("n")))
    return rows.select("source_name", "screen_date", "calibrated_risk", F.explode(F.array_compact(F.array(added, taken))).alias("e")).select("source_name", "screen_date", "calibrated_risk", "e.batch", "e.n")


def latest_capacities(requests: DataFrame) -> DataFrame:
    """(capacity_id, source_name, screen_date, review_capacity) of the latest request of a source and day, if it asks for 1 or more."""
    newest = Window.partitionBy("source_name", "screen_date").orderBy(F.col("requested_utc").desc_nulls_last(), F.col("capacity_id").desc())
    rows = requests.select("capacity_id", plain_source("source_name").alias("source_name"), "screen_date", "review_capacity", "requested_utc")
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1 AND review_capacity >= 1").drop("__n", "requested_utc")


KEYS = ["source_name", "screen_date"]


def capacity_cutoffs(rows: DataFrame, capacities: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cutoffs of the sources and days of `scored_rows` with a capacity, with the capacity_id."""
    asked = capacities.select(*KEYS)
    # only keys that somebody asks for; one row a source and day
    counts = settle(score_counts(score_events(rows).join(asked, KEYS, "left_semi"), KEYS, "calibrated_risk"))
    tree = settle(batch_nodes(counts, KEYS, "calibrated_risk"))
    cuts = exact_cutoffs(counts, tree, capacities, KEYS, "calibrated_risk", "review_capacity", settle)
    return cuts.join(capacities.select(*KEYS, "capacity_id"), KEYS)


def cutoff_history(rows: DataFrame, capacities: DataFrame, settle: Callable[[DataFrame], DataFrame], days: tuple[int, ...] = (0, 2)) -> DataFrame:
    """(capacity_id, days_after, n_records, cutoff, n_kept): the cutoffs as they were some days after the screening day, from one stored tree.

    Nothing kept: no cutoff, size 0. A source and day without a record by then has no row.
    """
    counts = settle(score_counts(score_events(rows).join(capacities.select(*KEYS), KEYS, "left_semi"), KEYS, "calibrated_risk"))
    tree = settle(batch_nodes(counts, KEYS, "calibrated_risk"))
    out = None
    for after in days:
        upto = F.date_add("screen_date", after)
        then = as_of(counts, upto)
        cuts = exact_cutoffs(then, as_of(tree, upto), capacities, KEYS, "calibrated_risk", "review_capacity", settle)
        alive = then.groupBy(*KEYS, "calibrated_risk").agg(F.sum("n").alias("n")).where("n > 0")
        held = kept(alive, cuts, KEYS, "calibrated_risk").groupBy(*KEYS).agg(F.min("calibrated_risk").alias("cutoff"), F.sum("n").alias("n_kept"))
        named = cuts.join(capacities.select(*KEYS, "capacity_id"), KEYS).join(held, KEYS, "left")
        part = named.select("capacity_id", F.lit(after).alias("days_after"), "n_records", "cutoff", F.coalesce("n_kept", F.lit(0).cast("bigint")).alias("n_kept"))
        out = part if out is None else out.unionByName(part)
    return out


def cutoff_report(rows: DataFrame, capacities: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per capacity request: records, cutoff (lowest score kept), kept size and the tiers it reaches.

    rows (of `scored_rows`) need risk_tier. Requests without a record or with nothing kept have kept size 0, no
    cutoff and no tier.
    """
    records = latest(rows)
    held = kept(records, settle(capacity_cutoffs(rows, capacities, settle)), KEYS, "calibrated_risk")
    by_tier = held.groupBy("capacity_id", plain_tier("risk_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("calibrated_risk").alias("low"))
    summed = by_tier.groupBy("capacity_id").agg(
        F.min("low").alias("cutoff"), F.sum("n").alias("n_kept"), F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers")
    )
    sizes = records.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_records"))
    zero = F.lit(0).cast("bigint")
    return (
        capacities.join(sizes, KEYS, "left")
        .join(summed, "capacity_id", "left")
        .select("capacity_id", "source_name", "screen_date", F.col("review_capacity").cast("bigint").alias("review_capacity"), F.coalesce("n_records", zero).alias("n_records"), "cutoff", F.coalesce("n_kept", zero).alias("n_kept"), F.coalesce("tiers", F.lit("")).alias("tiers"))
    )


def fraction_cutoffs(events: DataFrame, keys: list[str], score: str, fraction: float, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, target, n_records, cutoff, n_kept): per key the lowest cutoff that keeps at most floor(fraction * n)."""
    counts = settle(score_counts(events, keys, score))
    tree = settle(batch_nodes(counts, keys, score))
    targets = counts.groupBy(*keys).agg(F.floor(F.sum("n") * F.lit(fraction)).alias("want"))
    cuts = exact_cutoffs(counts, tree, targets, keys, score, "want", settle)
    alive = counts.groupBy(*keys, score).agg(F.sum("n").alias("n")).where("n > 0")
    held = kept(alive, cuts, keys, score).groupBy(*keys).agg(F.min(score).alias("cutoff"), F.sum("n").alias("n_kept"))
    return cuts.select(*keys, "target", "n_records").join(held, keys, "left").select(*keys, "target", "n_records", "cutoff", F.coalesce("n_kept", F.lit(0).cast("bigint")).alias("n_kept"))
