"""Name and value cleaning shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
BLANKS = " \t\n\r\f\v"


def plain_source(name: str | Column) -> Column:
    """A source name trimmed and in lower case; null stays null."""
    return F.lower(F.btrim(F.col(name) if isinstance(name, str) else name, F.lit(BLANKS)))


def plain_tier(name: str | Column) -> Column:
    """A tier name in upper case with single underscores: ' Urgent Review' -> 'URGENT_REVIEW'."""
    column = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.upper(F.btrim(column, F.lit(BLANKS))), r"[\s_-]+", "_")


def number_within(column: str | Column, low: float, high: float) -> Column:
    """The value where it is a number of low..high, else null (null and NaN included)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull() & ~F.isnan(c) & c.between(low, high), c)
