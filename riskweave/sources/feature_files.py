"""Files of feature lines: which lines count, which files follow one another, and the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import plain_name
from ..session import checked_broadcast

#: Registries are small, fixed tables; more rows than this are refused rather than sent to the driver.
MAX_REGISTRY_ROWS = 10_000
#: Ids of repeated lines that are broadcast at most (8 bytes each).
MOST_REPEATS = 2_000_000
#: Kinds whose values are numbers, and kinds whose values are texts with a pattern.
NUMBER_KINDS = ("amount", "ratio", "count")
TEXT_KINDS = ("code", "date")


@dataclass(frozen=True)
class Feature:
    """One registry row."""

    feature: str
    variable_name: str
    value_kind: str
    is_required: bool
    lo_bound: float | None
    hi_bound: float | None
    value_pattern: str | None


def load_registry(registry: DataFrame) -> list[Feature]:
    """The registry's rows, in order of feature."""
    rows = registry.select("feature", "variable_name", "value_kind", "is_required", "lo_bound", "hi_bound", "value_pattern").orderBy("feature").limit(MAX_REGISTRY_ROWS + 1).collect()
    if len(rows) > MAX_REGISTRY_ROWS:
        raise ValueError(f"a registry of more than {MAX_REGISTRY_ROWS} rows")
    number = lambda x: None if x is None or x != x else float(x)
    return [Feature(r[0], r[1], r[2], bool(r[3]), number(r[4]), number(r[5]), r[6]) for r in rows]


def names_of(registry: list[Feature]) -> dict[str, int]:
    """Plain name -> position in the registry, for features and variable names."""
    return {plain_name(n): i for i, f in enumerate(registry) for n in (f.variable_name, f.feature) if n}


def counted_lines(lines: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The lines without repeats: of each (file_id, line_no) the row with the lowest line_id.

    Lines without a file_id are left out; those without a line_no count each for itself.

    Only ids are shuffled; the repeats found (few: their ids are stored by settle(df) and
    broadcast up to MOST_REPEATS of them) are then left out of each scan of the texts.
    """
    copies = Window.partitionBy("file_id", "line_no").orderBy("line_id")
    again = lines.where("line_no IS NOT NULL").select("line_id", "file_id", "line_no").withColumn("__n", F.row_number().over(copies)).where("__n > 1").select("line_id")
    return lines.where("file_id IS NOT NULL").join(checked_broadcast(settle(again), MOST_REPEATS), "line_id", "left_anti")


def file_sequence(lines: DataFrame) -> DataFrame:
    """(file_id, source_name, file_seq, n_rows, prev_file_id): each file and the one before it of its source.

    The window runs over one row a file.
    """
    files = lines.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("source_name").alias("source_name"), F.min("file_seq").alias("file_seq"), F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy("source_name").orderBy("file_seq", "file_id")
    return files.withColumn("prev_file_id", F.lag("file_id").over(before))
