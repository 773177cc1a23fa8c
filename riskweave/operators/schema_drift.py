"""Schemas that drift between files (problem 3): matching by similarity flooding, casting, reporting.

Each file has a schema graph: its root, its fields, and for each field a node for its
plain name, for each token of the name, for its type, for the registry feature it
resolves to and for the names nested in it. The graphs of a file and the one before it
are laid over each other: a pair of nodes gets a starting score (equal names, features
and types; the share of the accounts of both files whose values agree), and scores
flow along equally named edges until they settle. A field that stays is an anchor, the
pair all others are measured against. The pairs whose settled score stands out are
selected; nothing else can be reported as a rename, and a selected pair is reported if
the exact rule holds for it. Pairs are those of fields that vanish and fields that appear.

A first scan counts the types of each field of each file (every worker sends one row a
file and field); values are read again only for the fields that vanish or appear, and
meet by equality, never as a product of fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_number, is_missing, json_object, plain_name, words_of
from ..session import checked_broadcast, python_tasks
from ..sources.feature_files import NUMBER_KINDS, Feature, counted_lines, file_sequence, names_of

TYPES = ("number", "string", "boolean")
#: Values agree if at least this share of the accounts with both, and so many in all, hold the same.
AGREE_SHARE, AGREE_ACCOUNTS = 0.9, 10
#: Selection keeps a pair whose settled score is at least this share of the anchor's. A pair gets no less flow than the anchor, so its share
#: never falls below that of their starting scores: 0.9 and more for all that the exact rule may accept.
KEEP_SCORE = 0.6
#: How much of a score flows along names, features, tokens, nested names and types.
FLOWS = (1.0, 1.0, 0.1, 0.1, 0.05)
#: Places in the signature of the names nested in a field.
NESTED_BITS = 63
#: Flooding stops when no score moves by more than this, or after so many rounds; what selection guarantees holds after any round.
SETTLED, MOST_ROUNDS = 1e-4, 60
#: Files whose wanted fields are broadcast at most (a few short names each).
MOST_FILES = 50_000
#: (file, field) counters a worker holds before it passes them on.
WORKER_FIELDS = 200_000


def _nested(value: dict) -> int:
    """Signature of the names in an object: one bit each, by hash of the plain name, so that it stays bounded and adds up by OR."""
    mask = 0
    for name in value:
        mask |= 1 << (xxhash.xxh64_intdigest(plain_name(name)) % NESTED_BITS)
    return mask


def field_counts(lines: DataFrame) -> DataFrame:
    """(file_id, field, n_number, n_string, n_boolean, nested): the types of a field's values that are not missing, and the names nested in it.

    Lines that are not one complete JSON object count nothing. A field whose values are all
    missing, or lists or objects, has a row of zeros.
    """
    schema = pa.schema([("file_id", pa.int64()), ("field", pa.string()), *((f"n_{t}", pa.int64()) for t in TYPES), ("nested", pa.int64())])

    def emit(counts: dict) -> pa.RecordBatch:
        rows = [(file, field, *n) for (file, field), n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        place = {float: 0, int: 0, str: 1, bool: 2}
        for batch in batches:
            for file, text in zip(batch.column("file_id").to_pylist(), batch.column("features").to_pylist()):
                found = json_object(text)
                if not found:
                    continue
                for field, value in found.items():
                    own = counts.get((file, field))
                    if own is None:
                        own = counts[file, field] = [0, 0, 0, 0]
                    at = place.get(type(value))
                    if at is None:
                        if type(value) is dict:
                            own[3] |= _nested(value)
                    elif not (at == 1 and is_missing(value)):
                        own[at] += 1
            if len(counts) > WORKER_FIELDS:
                yield emit(counts)
                counts = {}
        if counts:
            yield emit(counts)

    partial = lines.select("file_id", "features").mapInArrow(run, "file_id bigint, field string, n_number bigint, n_string bigint, n_boolean bigint, nested bigint")
    return partial.groupBy("file_id", "field").agg(*(F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES), F.bit_or("nested").alias("nested"))


def dominant_type() -> F.Column:
    """The most frequent type of a field, in the order number, string, boolean on a tie; null without values."""
    n, s, b = (F.col(f"n_{t}") for t in TYPES)
    return F.when(n + s + b == 0, F.lit(None)).when((n >= s) & (n >= b), "number").when(s >= b, "string").otherwise("boolean")


def _resolver(registry: list[Feature]) -> F.Column:
    """The feature a field resolves to, or null; the registry is a fixed, small table."""
    names = names_of(registry)
    if not names:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for name, i in names.items() for x in (name, registry[i].feature)))
    return F.try_element_at(table, F.regexp_replace(F.upper("field"), "[^A-Z0-9]+", ""))


def field_steps(counts: DataFrame, files: DataFrame, registry: list[Feature]) -> DataFrame:
    """(file_id, prev_file_id, field, in_file, in_prev, type, prev_type, nested, prev_nested, feature) for each file with one before it."""
    typed = counts.select("file_id", "field", dominant_type().alias("type"), "nested")
    later = files.where("prev_file_id IS NOT NULL").select("file_id", "prev_file_id")
    now = typed.join(later, "file_id").select("file_id", "prev_file_id", "field", F.lit(1).alias("now"), "type", "nested")
    then = typed.toDF("prev_file_id", "field", "prev_type", "prev_nested").join(later, "prev_file_id").select("file_id", "prev_file_id", "field", F.lit(1).alias("then"), "prev_type", "prev_nested")
    both = now.unionByName(then, allowMissingColumns=True).groupBy("file_id", "prev_file_id", "field").agg(
        F.max("now").isNotNull().alias("in_file"), F.max("then").isNotNull().alias("in_prev"), *(F.max(c).alias(c) for c in ("type", "prev_type", "nested", "prev_nested"))
    )
    return both.withColumn("feature", _resolver(registry))


def field_values(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, account_reference, field, value): the values of the wanted fields that are not missing, as texts that are equal if the values are.

    wanted: (file_id, fields) with an array of names. Numbers are compared as numbers, all else as trimmed
    text. Of an account's lines of a file the last that has a value counts.
    """
    schema = pa.schema([("file_id", pa.int64()), ("account_reference", pa.string()), ("line_no", pa.int32()), ("field", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, account, no, text, fields in zip(*(batch.column(c).to_pylist() for c in ("file_id", "account_reference", "line_no", "features", "fields"))):
                found = json_object(text)
                for field in fields if found else ():
                    value = found.get(field)
                    if is_missing(value):
                        continue
                    number = as_number(value)
                    rows.append((file, account, no, field, f"t{words_of(value)}" if number is None else f"n{number + 0.0!r}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    chosen = lines.where("account_reference IS NOT NULL").join(checked_broadcast(wanted, MOST_FILES), "file_id").select("file_id", "account_reference", "line_no", "features", "fields")
    read = chosen.mapInArrow(run, "file_id bigint, account_reference string, line_no int, field string, value string")
    last = F.max(F.struct(F.coalesce("line_no", F.lit(-1)).alias("no"), "value"))
    return read.groupBy("file_id", "account_reference", "field").agg(last["value"].alias("value"))


def value_agreement(lines: DataFrame, pairs: DataFrame, settle) -> DataFrame:
    """(file_id, old, new, n_both, n_same) for the pairs (file_id, prev_file_id, old, new) of fields that AGREE_ACCOUNTS or more accounts agree on.

    n_both counts the accounts of both files with a value under both names, n_same those where the
    two are the same. Equal values find each other by an equi-join on account and value; n_both is
    worked out only for the few pairs left, so the work grows with the lines and not with the product
    of vanished and new fields.
    """
    wanted = pairs.select("prev_file_id", "old").union(pairs.select("file_id", "new")).toDF("file_id", "field")
    values = settle(field_values(lines, settle(wanted.groupBy("file_id").agg(F.collect_set("field").alias("fields")))))
    old, new = pairs.select("file_id", "prev_file_id", "old").distinct(), pairs.select("file_id", "new").distinct()
    then = values.toDF("prev_file_id", "account_reference", "old", "value")
    now = values.toDF("file_id", "account_reference", "new", "value")
    equal = then.join(old, ["prev_file_id", "old"]).join(now.join(new, ["file_id", "new"]), ["file_id", "account_reference", "value"])
    same = equal.groupBy("file_id", "prev_file_id", "old", "new").agg(F.count(F.lit(1)).alias("n_same")).where(F.col("n_same") >= AGREE_ACCOUNTS)
    likely = settle(same.join(pairs, ["file_id", "prev_file_id", "old", "new"], "left_semi"))
    both = then.join(likely, ["prev_file_id", "old"]).join(now.drop("value"), ["file_id", "new", "account_reference"])
    return both.groupBy("file_id", "old", "new").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_same").alias("n_same"))


def _tokens(name: str) -> list[str]:
    return re.findall(r"[A-Z]+|[0-9]+", name.upper())


def _layers(old: list[tuple], new: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of property: which old and new fields have which values, and which pairs of values are equal."""
    bits = lambda f: [i for i in range(NESTED_BITS) if f[3] >> i & 1]
    layers = []
    for weight, pick in zip(FLOWS, (lambda f: [plain_name(f[0])], lambda f: [f[2]], lambda f: _tokens(f[0]), bits, lambda f: [f[1]])):
        left, right = ([[x for x in pick(f) if x is not None and x != ""] for f in side] for side in (old, new))
        lv, rv = sorted({x for own in left for x in own}), sorted({x for own in right for x in own})
        if lv and rv:
            a = np.array([[float(v in own) for v in lv] for own in left])
            b = np.array([[float(v in own) for v in rv] for own in right])
            layers.append((weight * a, b, np.array([[float(x == y) for y in rv] for x in lv])))
    return layers


def flood(old: list[tuple], new: list[tuple], agreement: np.ndarray) -> np.ndarray:
    """Settled scores of the pairs of old and new fields, each (name, type, feature, nested), as shares of the anchor's.

    agreement: the share of agreeing values of each pair, 0 where there is no evidence. A field that is
    in both files (the anchor) lies beside the given ones. Pairs of fields exchange scores with the
    pairs of their names, tokens, types, features and nested names, and with the pair of roots.
    """
    anchor = ("\0", None, None, 0)
    left, right = [*old, anchor], [*new, anchor]
    layers = _layers(left, right)
    ot, nt = [set(_tokens(f[0])) for f in left], [set(_tokens(f[0])) for f in right]
    overlap = np.array([[len(x & y) / max(1, len(x | y)) for y in nt] for x in ot])
    alike = np.array([[float(plain_name(x[0]) == plain_name(y[0]) and x[0] != "\0" and y[0] != "\0" or x[2] is not None and x[2] == y[2]) for y in right] for x in left])
    start = np.maximum(alike, 0.2 * overlap)
    start[:-1, :-1] = np.maximum(start[:-1, :-1], agreement)
    start[-1, -1] = 1.0
    start = start + 1e-3
    score, starts, root = start.copy(), [s for *_, s in layers], 1.0
    scores = [s.copy() for s in starts]
    for _ in range(MOST_ROUNDS):
        flow = np.full_like(score, root / score.size)
        nexts = []
        for (a, b, s0), s in zip(layers, scores):
            # a property pair gives to the field pairs that share it, evenly, and gets from them
            share = np.maximum(1.0, np.outer((a > 0).sum(0), b.sum(0)))
            flow += a @ (s / share) @ b.T
            nexts.append(s0 + s + a.T @ score @ b / share)
        fresh, root = start + score + flow, 1.0 + root + score.mean()
        top = max(fresh.max(), root, *(n.max() for n in nexts)) if nexts else max(fresh.max(), root)
        fresh, root = fresh / top, root / top
        moved = np.abs(fresh - score).max()
        score, scores = fresh, [n / top for n in nexts]
        if moved < SETTLED:
            break
    return score[:-1, :-1] / score[-1, -1]


_STEP = pa.schema([("file_id", pa.int64()), ("prev_file_id", pa.int64()), ("old", pa.string()), ("new", pa.string()), ("score", pa.float64()), ("by_name", pa.bool_()), ("rank_pair", pa.bool_())])


def correspondences(steps: DataFrame, agreement: DataFrame) -> DataFrame:
    """(file_id, prev_file_id, old, new, score, by_name, is_renamed, is_best): pairs that flooding selects.

    is_renamed: the exact rule holds (alike names, one feature, or agreeing values unless both
    resolve); is_best: the pair also is a stable match, one partner each, best scores first.
    A file's vanished and new fields are as many as its fields, whatever the number of lines.
    """
    vanished = steps.where("in_prev AND NOT in_file").select("file_id", "prev_file_id", F.struct("field", F.col("prev_type").alias("type"), "feature", F.col("prev_nested").alias("nested")).alias("f"), F.lit(0).alias("side"))
    fresh = steps.where("in_file AND NOT in_prev").select("file_id", "prev_file_id", F.struct("field", "type", "feature", "nested").alias("f"), F.lit(1).alias("side"))
    grouped = vanished.unionByName(fresh).groupBy("file_id", "prev_file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("f")))).alias("old"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("f")))).alias("new")
    )
    seen = agreement.groupBy("file_id").agg(F.collect_list(F.struct("old", "new", "n_both", "n_same")).alias("agreed"))
    both = grouped.where("size(old) > 0 AND size(new) > 0").join(seen, "file_id", "left")
    schema = pa.schema([*list(_STEP)[:6], ("is_renamed", pa.bool_()), ("is_best", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                old, new = ([(f["field"], f["type"], f["feature"], f["nested"] or 0) for f in r[side]] for side in ("old", "new"))
                place = ({f[0]: i for i, f in enumerate(old)}, {f[0]: i for i, f in enumerate(new)})
                agree, holds = np.zeros((len(old), len(new))), np.zeros((len(old), len(new)), bool)
                for p in r["agreed"] or ():
                    i, j = place[0][p["old"]], place[1][p["new"]]
                    if not (old[i][2] and new[j][2]):
                        agree[i, j] = p["n_same"] / p["n_both"] * min(1.0, p["n_same"] / AGREE_ACCOUNTS)
                        holds[i, j] = p["n_same"] >= AGREE_ACCOUNTS and p["n_same"] * 10 >= p["n_both"] * 9
                by_name = np.array([[plain_name(x[0]) == plain_name(y[0]) or bool(x[2]) and x[2] == y[2] for y in new] for x in old])
                score = flood(old, new, agree)
                keep = score >= KEEP_SCORE
                true = keep & (holds | by_name)
                left, right, best = set(), set(), set()
                for i, j in sorted(zip(*np.nonzero(true)), key=lambda p: (-score[p], p)):
                    if i not in left and j not in right:
                        left.add(i)
                        right.add(j)
                        best.add((i, j))
                for i, j in zip(*np.nonzero(keep)):
                    rows.append((r["file_id"], r["prev_file_id"], old[i][0], new[j][0], float(score[i, j]), bool(by_name[i, j]), bool(true[i, j]), (i, j) in best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return both.repartition(python_tasks(steps.sparkSession), "file_id").mapInArrow(run, "file_id bigint, prev_file_id bigint, old string, new string, score double, by_name boolean, is_renamed boolean, is_best boolean")


def candidate_pairs(steps: DataFrame) -> DataFrame:
    """(file_id, prev_file_id, old, new): pairs whose values decide, i.e. not both resolved and not alike by name."""
    name = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")
    old = steps.where("in_prev AND NOT in_file").select("file_id", "prev_file_id", F.col("field").alias("old"), F.col("feature").alias("f0"))
    new = steps.where("in_file AND NOT in_prev").select("file_id", F.col("field").alias("new"), F.col("feature").alias("f1"))
    open_ = (F.col("f0").isNull() | F.col("f1").isNull()) & (name("old") != name("new"))
    return old.join(new, "file_id").where(open_).select("file_id", "prev_file_id", "old", "new")


def drift_changes(steps: DataFrame, matches: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, new_name) of the changes between consecutive files."""
    pairs = matches.where("is_renamed").select("file_id", "old", "new")
    renamed = pairs.select("file_id", F.lit("renamed").alias("change_kind"), F.col("old").alias("field_name"), F.col("new").alias("new_name"))
    one_sided = steps.where("in_file <> in_prev").select("file_id", "field", "in_file", "type", "prev_type")
    touched = pairs.select("file_id", F.col("old").alias("field"), F.lit(False).alias("in_file")).union(pairs.select("file_id", "new", F.lit(True))).distinct()
    lone = one_sided.join(touched, ["file_id", "field", "in_file"], "left_anti").select(
        "file_id", F.when(F.col("in_file"), "added").otherwise("removed").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("new_name")
    )
    stayed = steps.where("in_file AND in_prev AND type <> prev_type").select("file_id", "field")
    types0 = one_sided.where("NOT in_file").select("file_id", F.col("field").alias("old"), F.col("prev_type"))
    types1 = one_sided.where("in_file").select("file_id", F.col("field").alias("new"), F.col("type"))
    moved = pairs.join(types0, ["file_id", "old"]).join(types1, ["file_id", "new"]).where("type <> prev_type").select("file_id", F.col("new").alias("field"))
    retyped = stayed.union(moved).distinct().select("file_id", F.lit("type_changed").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("new_name"))
    return renamed.union(lone).union(retyped)


def unexpected_fields(counts: DataFrame, files: DataFrame, registry: list[Feature]) -> DataFrame:
    """(file_id, n_unexpected): how many of a file's fields resolve to no feature."""
    per_file = counts.withColumn("feature", _resolver(registry)).groupBy("file_id").agg(F.count_if(F.col("feature").isNull()).alias("n"))
    return files.select("file_id").join(per_file, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_unexpected"))


def miscounts(unexpected: DataFrame, dry_runs: DataFrame) -> DataFrame:
    """Dry runs whose figure of unexpected columns is given and wrong, as rows of `drift_changes`."""
    wrong = dry_runs.select("file_id", "n_unexpected_columns").join(unexpected, "file_id").where("n_unexpected_columns <> n_unexpected")
    return wrong.select("file_id", F.lit("miscounted").alias("change_kind"), F.lit("n_unexpected_columns").alias("field_name"), F.lit("").alias("new_name")).distinct()


def column_names(steps: DataFrame, counts: DataFrame, matches: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """(file_id, field, column_name): the column of the one table that a field of a file goes to.

    A field that resolves goes to its feature. Another follows the best matches back: from file to
    file under its own name or the name it was renamed from, to a feature or else to its first
    name. Chains are shortened by pointer doubling over file-level rows; settle(df) stores a
    round's result.
    """
    here = counts.withColumn("feature", _resolver(registry)).select("file_id", "field", "feature")
    kept = steps.where("in_file AND in_prev").select("file_id", "field", F.col("prev_file_id").alias("p_file"), F.col("field").alias("p_field"))
    moved = matches.where("is_best").select("file_id", F.col("new").alias("field"), F.col("prev_file_id").alias("p_file"), F.col("old").alias("p_field"))
    links = here.join(kept.union(moved), ["file_id", "field"], "left")
    unresolved = F.col("feature").isNull() & F.col("p_file").isNotNull()
    now = settle(links.select("file_id", "field", "feature", F.when(unresolved, F.col("p_file")).alias("p_file"), F.when(unresolved, F.col("p_field")).alias("p_field")))
    while not now.where("p_file IS NOT NULL").isEmpty():
        up = now.select(F.col("file_id").alias("p_file"), F.col("field").alias("p_field"), F.col("feature").alias("u_feature"), F.col("p_file").alias("u_file"), F.col("p_field").alias("u_field"), F.lit(True).alias("hit"))
        root = F.when(F.col("feature").isNotNull(), F.col("feature")).when(F.col("hit") & F.col("u_file").isNull(), F.coalesce("u_feature", "p_field"))
        nxt = now.join(up, ["p_file", "p_field"], "left").select(
            "file_id", "field", root.alias("feature"), F.when(root.isNull(), F.col("u_file")).alias("p_file"), F.when(root.isNull(), F.col("u_field")).alias("p_field")
        )
        now = settle(nxt)
    return now.select("file_id", "field", F.coalesce("feature", "field").alias("column_name"))


def united_table(lines: DataFrame, columns: DataFrame, registry: list[Feature], settle) -> DataFrame:
    """(file_id, line_no, account_reference, one typed column per feature, other): all lines in one schema.

    Amounts, ratios and counts are doubles (null where the value is missing or no number), flags
    0/1 doubles, codes and dates trimmed strings. `other` maps the columns without a feature to
    their texts. Where several fields of a line go to one column, the first in order of name with
    a value counts.
    """
    numbers = {f.feature: f.value_kind in NUMBER_KINDS or f.value_kind == "flag" for f in registry}
    own = {name: registry[i].feature for name, i in names_of(registry).items()}
    schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("account_reference", pa.string()), *((f, pa.float64() if n else pa.string()) for f, n in numbers.items()), ("other", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            known: dict[str, str | None] = {}
            for file, no, account, text, names in zip(*(batch.column(c).to_pylist() for c in ("file_id", "line_no", "account_reference", "features", "names"))):
                found = json_object(text)
                if found is None:
                    continue
                to, row, other = dict(names or ()), {}, {}
                for field in sorted(found):
                    value = found[field]
                    if is_missing(value):
                        continue
                    if field not in known:
                        known[field] = own.get(plain_name(field))
                    column = known[field] or to.get(field, field)
                    if column not in numbers:
                        other.setdefault(column, value if type(value) is str else words_of(value))
                    elif row.get(column) is None:
                        if numbers[column]:
                            row[column] = float(value) if type(value) is bool else as_number(value)
                        else:
                            row[column] = words_of(value)
                out["file_id"].append(file)
                out["line_no"].append(no)
                out["account_reference"].append(account)
                for column in numbers:
                    out[column].append(row.get(column))
                out["other"].append(list(other.items()))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    # only fields that follow a rename need to be told; names in the registry are known everywhere
    moved = columns.where((F.col("column_name") != F.col("field")) & _resolver(registry).isNull())
    named = moved.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "column_name"))).alias("names"))
    kinds = ", ".join(f"`{f}` {'double' if n else 'string'}" for f, n in numbers.items())
    source = lines.join(checked_broadcast(settle(named), MOST_FILES), "file_id", "left").select("file_id", "line_no", "account_reference", "features", "names")
    return source.mapInArrow(run, f"file_id bigint, line_no int, account_reference string, {kinds}, other map<string,string>")


class SchemaDrift:
    """The drift of one table of feature lines against a registry; parts are worked out when asked for.

    lines: (line_id, file_id, source_name, file_seq, line_no, account_reference, features); other
    columns are not read. Defined cases: a repeated (file_id, line_no) counts once, a null or broken
    features not at all, a file without counted lines has no fields, an empty table no change; lines
    without an account_reference give no evidence of values.
    """

    def __init__(self, lines: DataFrame, registry: list[Feature], settle):
        """settle(df) stores an intermediate result of file-level rows that is used more than once."""
        self.registry, self.settle = registry, settle
        lines = lines.select("line_id", "file_id", "source_name", "file_seq", "line_no", "account_reference", "features")
        self.files = settle(file_sequence(lines))
        self.lines = counted_lines(lines, settle)
        self.counts = settle(field_counts(self.lines))
        self.steps = settle(field_steps(self.counts, self.files, registry))
        pairs = candidate_pairs(self.steps)
        self.matches = settle(correspondences(self.steps, value_agreement(self.lines, settle(pairs), settle)))

    def changes(self, dry_runs: DataFrame) -> DataFrame:
        """(file_id, change_kind, field_name, new_name)."""
        found = miscounts(unexpected_fields(self.counts, self.files, self.registry), dry_runs)
        return drift_changes(self.steps, self.matches).union(found)

    def table(self) -> DataFrame:
        """All lines under one schema."""
        return united_table(self.lines, column_names(self.steps, self.counts, self.matches, self.registry, self.settle), self.registry, self.settle)
