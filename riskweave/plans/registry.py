"""Collects queries and their SQL where they are written."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries of one module, by function name."""

    def __init__(self):
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Registers the decorated query, with its SQL if it has one."""

        def keep(query: Callable) -> Callable:
            self._queries[query.__name__] = query
            if sql is not None:
                self._sql[query.__name__] = sql
            return query

        return keep

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
