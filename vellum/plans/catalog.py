"""All queries of the library by name, with the SQL that they are held against."""

from __future__ import annotations

from . import ingest, reading, store, words

FLAGSHIP = "book_outline"
_MODULES = (reading, store, words, ingest)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
