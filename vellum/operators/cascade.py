"""Deletes that follow declared keys from table to table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """``table.column`` names a row of ``parent``; ``action`` (cascade or set null) is what its end does."""

    table: str
    column: str
    parent: str
    action: str = "cascade"


#: fixed values: the library's keys
KEYS = [
    Key("books", "last_page_id", "pages", "set null"),
    Key("pages", "book_id", "books"),
    Key("blocks", "page_id", "pages"),
    Key("summaries", "block_id", "blocks"),
    Key("critiques", "summary_id", "summaries"),
    Key("rollups", "book_id", "books"),
    Key("lookups", "book_id", "books"),
    Key("lookups", "block_id", "blocks", "set null"),
    Key("vocab", "book_id", "books"),
    Key("vocab", "first_lookup_id", "lookups", "set null"),
]


def _order(tables, keys: list[Key]) -> list[str]:
    """Tables such that every cascade leads from an earlier to a later one."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(k.table == t and k.action == "cascade" and k.parent in left and k.parent != t for k in keys)]
        if not free:
            raise ValueError("cascades go round in a circle: " + ", ".join(left))
        out += free
        left = [t for t in left if t not in free]
    return out


def delete(tables: dict[str, DataFrame], gone: dict[str, DataFrame], keys: list[Key] | None = None) -> dict[str, DataFrame]:
    """The tables, each with a unique ``id``, without the rows ``gone`` (``id`` by table) and all that hangs on them.

    Rows go along cascades from table to table, one semi-join for each key; what is left loses
    its references to rows that went where the key says so.
    """
    keys = [k for k in (KEYS if keys is None else keys) if k.table in tables and k.parent in tables]
    lost: dict[str, DataFrame] = {t: ids.select("id") for t, ids in gone.items()}
    for name in _order(tables, keys):
        for k in keys:
            if k.table == name and k.action == "cascade" and k.parent in lost and k.parent != name:
                hit = tables[name].join(lost[k.parent].select(F.col("id").alias(k.column)), k.column, "left_semi").select("id")
                lost[name] = lost[name].unionAll(hit) if name in lost else hit
        if name in lost:
            lost[name] = lost[name].distinct()
    out = {}
    for name, rows in tables.items():
        own = rows.join(lost[name], "id", "left_anti") if name in lost else rows
        for k in keys:
            if k.table == name and k.action == "set null" and k.parent in lost:
                dead = lost[k.parent].select(F.col("id").alias(k.column), F.lit(True).alias("_dead"))
                own = own.join(dead, k.column, "left").withColumn(k.column, F.when(F.col("_dead").isNull(), F.col(k.column))).drop("_dead")
        out[name] = own.select(*rows.columns)
    return out
