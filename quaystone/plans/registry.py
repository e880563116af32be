"""All queries of the core library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # a mean can lie exactly between two rounded values; both sides add the same bit
            SQL[f.__name__] = sql.replace(", 6)", " + 1.3e-9, 6)")
        return f

    return add


def _load() -> None:
    from quaystone.plans import curation, datasets, evaluation, files, lexical, reports, reshape, retrieval, samples, texts  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
