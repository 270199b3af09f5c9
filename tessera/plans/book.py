"""A decorator that puts a query and its SQL twin side by side."""

from __future__ import annotations

from collections.abc import Callable


def book() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(twin: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if twin is not None:
                sql[f.__name__] = twin
            return f

        return add

    return queries, sql, query
