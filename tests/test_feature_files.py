"""Schema drift and column quality against plain Python, and on awkward lines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.values import as_number, is_missing, json_object
from riskweave.operators import quality, schema_drift
from riskweave.operators.schema_drift import KEEP_SCORE, SchemaDrift, flood
from riskweave.session import cut_lineage, read_table
from riskweave.sources.feature_files import Feature, load_registry
from tests.helpers import feature_file_truth as truth
from tests.helpers.compare import SMALL

LINES = "line_id bigint, file_id bigint, source_name string, file_seq int, line_no int, account_reference string, features string, fields string, names string"
REGISTRY = [
    Feature("F1", "AMT_A", "amount", True, 0.0, 100.0, None),
    Feature("F2", "CODE_B", "code", True, None, None, "^[A-Z][0-9]$"),
    Feature("F3", "FLAG_C", "flag", False, None, None, None),
]


def table(spark, files, extra=()):
    """files: {(source, seq): [(account, object or raw text)]}, each in order."""
    rows, n = [], 0
    for f, ((source, seq), lines) in enumerate(files.items(), 1):
        for k, (account, features) in enumerate(lines, 1):
            n += 1
            rows.append((n, f, source, seq, k, account, features if features is None or isinstance(features, str) else json.dumps(features), "clash", "clash"))
    rows += [(n + 1 + i, *r) for i, r in enumerate(extra)]
    return spark.createDataFrame(rows, LINES)


def drift(spark, df):
    return {tuple(r) for r in SchemaDrift(df, REGISTRY, cut_lineage).changes(spark.createDataFrame([], "file_id bigint, n_unexpected_columns int")).collect()}


def test_values():
    assert [as_number(x) for x in (1, 2.5, " -3e2 ", "+.5", "1.", "x", "", True, None, "1_0", "٣")] == [1, 2.5, -300, 0.5, 1, None, None, None, None, None, None]
    assert [is_missing(x) for x in (None, "", " na ", "N/A", "Null", 0, False, "nan")] == [True] * 5 + [False] * 3
    assert json_object('{"a": NaN}') is None and json_object("[1]") is None and json_object('{"a": 1} x') is None and json_object(None) is None
    assert json_object(' {"a": {"b": 1}} ') == {"a": {"b": 1}}


@pytest.mark.parametrize("kind", ["p3", "p5"])
def test_found_equals_plain_python(spark, kind):
    from riskweave.plans import training

    got = [tuple(r) for r in getattr(training, f"{kind}_found")(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == getattr(truth, kind)(SMALL)


def test_renames_by_values_and_names(spark):
    accounts = [f"a{i}" for i in range(12)]
    first = [(a, {"AMT_A": i, "mystery": f"v{i}", "gone": 1, "x y": "t"}) for i, a in enumerate(accounts)]
    second = [(a, {"amt-a": str(i), "other": f" v{i}", "fresh": 2, "XY": 3}) for i, a in enumerate(accounts)]
    got = drift(spark, table(spark, {("s", 1): first, ("s", 5): second}))
    assert got == {
        (2, "renamed", "AMT_A", "amt-a"), (2, "renamed", "mystery", "other"), (2, "renamed", "x y", "XY"), (2, "removed", "gone", ""), (2, "added", "fresh", ""),
        (2, "type_changed", "amt-a", ""), (2, "type_changed", "XY", ""),
    }


def test_nine_accounts_are_too_few(spark):
    first, second = ([(f"a{i}", {name: i}) for i in range(9)] for name in ("before", "after"))
    assert drift(spark, table(spark, {("s", 1): first, ("s", 2): second})) == {(2, "removed", "before", ""), (2, "added", "after", "")}


def test_two_resolving_fields_never_match_by_value(spark):
    first, second = ([(f"a{i}", {name: i}) for i in range(20)] for name in ("F1", "F3"))
    assert drift(spark, table(spark, {("s", 1): first, ("s", 2): second})) == {(2, "removed", "F1", ""), (2, "added", "F3", "")}


def test_broken_repeated_and_null_lines(spark):
    files = {("s", 1): [("a", {"F1": 1}), (None, None), ("b", "{broken"), ("c", "[1]")], ("s", 2): [(None, {"F1": None, "new": []})], ("t", 1): []}
    df = table(spark, files, extra=[(1, "s", 1, 1, "a", '{"late": 1}', "", "")])  # a repeat of file 1, line 1
    assert drift(spark, df) == {(2, "added", "new", "")}


def test_nulls_in_every_column(spark):
    rows = [(1, 1, "s", 1, 1, "a", '{"F1": 1}', "", ""), (2, 2, "s", 2, None, "a", '{"F1": "x"}', "", ""), (3, 2, "s", 2, None, "a", '{"F1": "y"}', "", ""), (None, None, None, None, None, None, None, None, None), (4, None, "s", 3, 1, "a", '{"zz": 1}', "", ""), (5, 3, None, None, 1, None, '{"F1": 2}', "", "")]
    df = spark.createDataFrame(rows, LINES)
    assert drift(spark, df) == {(2, "type_changed", "F1", "")}
    profile = {r.file_id: r for r in quality.file_profile(df, REGISTRY, cut_lineage).collect()}
    assert set(profile) == {1, 2, 3} and profile[2].n_lines == 2 and profile[2].n_fault == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], LINES)
    assert drift(spark, df) == set()
    assert quality.file_profile(df, REGISTRY, cut_lineage).count() == 0
    assert SchemaDrift(df, REGISTRY, cut_lineage).table().count() == 0


def test_united_table_follows_renames(spark):
    accounts = [f"a{i}" for i in range(12)]
    first = [(a, {"F1": i, "memo": f"m{i}", "CODE_B": "A1"}) for i, a in enumerate(accounts)]
    second = [(a, {"odd": str(i), "note": f"m{i}", "F3": True}) for i, a in enumerate(accounts)]
    third = [(a, {"odd": "NA", "note": "z"}) for a in accounts]
    rows = {(r.file_id, r.line_no): r for r in SchemaDrift(table(spark, {("s", 1): first, ("s", 2): second, ("s", 3): third}), REGISTRY, cut_lineage).table().collect()}
    assert rows[1, 4].F1 == 3.0 and rows[1, 4].F2 == "A1" and rows[1, 4].other == {"memo": "m3"}
    assert rows[2, 4].F1 == 3.0 and rows[2, 4].F3 == 1.0 and rows[2, 4].other == {"memo": "m3"}
    assert rows[3, 4].F1 is None and rows[3, 4].other == {"memo": "z"}


def test_flooding_prefers_agreement():
    score = flood([("alpha", "number", None, 0), ("beta", "string", None, 0)], [("beta2", "string", None, 0), ("zzz", "number", None, 0)], np.array([[0.0, 1.0], [0.0, 0.0]]))
    assert score[0, 1] == score.max() and score[1, 0] > score[1, 1] and score[1, 0] > score[0, 0]


def test_flooding_rejects_what_nothing_speaks_for():
    fields = lambda names: [(n, "number", None, 0) for n in names]
    old, new = fields(["alpha_7", "beta", "gamma", "one", "two"]), fields(["alpha-7", "delta", "zeta", "three", "four"])
    agreement = np.zeros((5, 5))
    agreement[1, 2] = 0.9
    kept = {(int(i), int(j)) for i, j in zip(*np.nonzero(flood(old, new, agreement) >= KEEP_SCORE))}
    assert kept == {(0, 0), (1, 2)}


def test_nested_names_speak_for_a_pair():
    mask = schema_drift._nested({"city": 1, "zip": 2})
    assert mask == schema_drift._nested({"ZIP": "", "City ": None}) != schema_drift._nested({"street": 1})
    score = flood([("a", None, None, mask), ("b", None, None, 0)], [("c", None, None, 0), ("d", None, None, mask)], np.zeros((2, 2)))
    assert score[0, 1] == score.max()


def test_last_line_of_an_account_counts(spark):
    accounts = [f"a{i}" for i in range(12)]
    first = [(a, {"before": i}) for i, a in enumerate(accounts)]
    second = [(a, {"after": -1}) for a in accounts] + [(a, {"after": str(i)}) for i, a in enumerate(accounts)] + [(a, {"after": "NA"}) for a in accounts]
    assert (2, "renamed", "before", "after") in drift(spark, table(spark, {("s", 1): first, ("s", 2): second}))


def issues(spark, files):
    return {tuple(r) for r in quality.column_issues(quality.file_profile(table(spark, files), REGISTRY, cut_lineage)).collect()}


def test_issues(spark):
    first = [(f"a{i}", {"F1": i, "F2": "A1", "F3": 1}) for i in range(20)]
    second = [(f"a{i}", {"AMT_A": 100.00000001 if i else "bad", "F2": "A1 " if i == 3 else "N/A", "F3": None}) for i in range(20)]
    assert issues(spark, {("s", 1): first, ("s", 2): second}) == {(2, "F1", "constant"), (2, "F1", "pattern"), (2, "F1", "shift"), (2, "F2", "null_rate"), (2, "F2", "pattern"), (2, "F3", "null_rate")}


def test_range_slack_and_booleans(spark):
    got = issues(spark, {("s", 1): [("a", {"F1": -1e-8}), ("b", {"F1": True}), ("c", {"F1": 100.1})]})
    assert got == {(1, "F1", "range"), (1, "F1", "pattern")}


def test_states_merge_in_any_partitioning(spark):
    registry = load_registry(read_table(spark, SMALL, "feature_registry"))
    lines = read_table(spark, SMALL, "score_requests")
    sizes = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def metrics(df, sizes=None):
        states = quality.scan_states(df, registry, sizes)
        return {tuple(r) for r in quality.metrics_of(states, registry, cut_lineage).collect()}

    open_ = metrics(lines.coalesce(1))
    assert open_ == metrics(lines.repartition(9)) == metrics(lines.coalesce(1), sizes) == metrics(lines.repartition(9), sizes)
    closed = quality.scan_states(lines.coalesce(1), registry, sizes)
    assert closed.where("held IS NOT NULL").count() == 0 and closed.count() == len(open_)


def test_loads_add_up(spark):
    registry = load_registry(read_table(spark, SMALL, "feature_registry"))
    lines = read_table(spark, SMALL, "score_requests")
    parts = [quality.load_states(lines.where(f"line_id % 3 = {k}"), registry, cut_lineage) for k in range(3)]
    once = lines.dropDuplicates(["file_id", "line_no"])
    merged = quality.metrics_of(parts[2].unionByName(parts[0]).unionByName(parts[1]), registry, cut_lineage)
    n = {r.file_id: r.n_lines for r in merged.where("feature < 0").collect()}
    assert set(n) <= {r.file_id for r in once.select("file_id").distinct().collect()} and sum(n.values()) >= 300


def test_large_files_give_the_same_profile(spark, monkeypatch):
    registry = load_registry(read_table(spark, SMALL, "feature_registry"))
    profile = lambda: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in quality.file_profile(read_table(spark, SMALL, "score_requests"), registry, cut_lineage).collect()}
    plain = profile()
    monkeypatch.setattr(quality, "MOST_FILES", 0)
    assert profile() == plain
    monkeypatch.setattr(quality, "LARGE_FILE", 50)
    assert profile() == plain


def test_dry_run_figures(spark):
    rows = [(1, None, 1.0), (2, 99, float("nan")), (3, 0, -0.1), (4, -1, 1.00000001)]
    got = {tuple(r) for r in quality.dry_run_issues(spark.createDataFrame(rows, "file_id bigint, n_missing_required int, schema_completeness double"), REGISTRY).collect()}
    assert got == {(1, "n_missing_required", "null_rate"), (2, "n_missing_required", "range"), (2, "schema_completeness", "null_rate"), (3, "schema_completeness", "range"), (4, "n_missing_required", "range")}
