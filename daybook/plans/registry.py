"""A decorator that files a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, Callable]:
    found: dict = {}

    def register(sql: str | None = None, name: str | None = None):
        def put(f):
            own = name or f.__name__
            if own in found:
                raise ValueError(f"query {own} is registered twice")
            found[own] = (f, sql)
            return f

        return put

    return found, register
