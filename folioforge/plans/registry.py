"""Decorator that registers a query with its oracle."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
