"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, ensembles, features, governance, graph, learned, ranking, records, similarity, storage, tables, training, validation

_MODULES = (training, ranking.R, graph.R, features.R, tables.R, similarity.R, records.R, learned.R, storage.R, validation.R, documents.R, ensembles.R, governance.R)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking quality per repeat."""
    return ranking.flagship(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
