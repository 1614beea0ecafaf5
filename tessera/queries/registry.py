"""A table of queries, filled by decorator."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Name to (query, SQL or None)."""

    def query(self, sql: str | None = None) -> Callable:
        def put(fn):
            self[fn.__name__] = (fn, sql)
            return fn

        return put
