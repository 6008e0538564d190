"""How the modules of queries note a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries, SQL, and a decorator that takes the SQL of the query below it."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def note(run):
            queries[run.__name__] = run
            if text is not None:
                sql[run.__name__] = text
            return run

        return note

    return queries, sql, query
