"""A registry a module: query(sql) adds a function and, where there is one, its SQL."""

from __future__ import annotations


def registry():
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
