"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    An outer expression inside a lambda is computed again for each element; a lambda's own
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of_equals(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The elements that are the first with their key, in order; those with a null key all stay.

    Keys are sorted with their places, so the time is that of a sort.
    """

    def kept(rows):
        keyed = F.transform(rows, lambda x, i: F.struct(key(x).alias("key"), i.alias("at")))
        single = let(F.array_sort(keyed), lambda s: F.filter(s, lambda x, k: x["key"].isNull() | ~x["key"].eqNullSafe(F.get(s, k - 1)["key"]) | (k == 0)))
        return F.transform(F.array_sort(F.transform(single, lambda x: x["at"])), lambda i: F.get(rows, i))

    return let(rows, kept)


def part_of(rows: Column, start: Column, end: Column) -> Column:
    """The elements from place ``start`` up to before ``end``, from 0; null where there are none.

    For many parts of one array inside a lambda, where ``slice`` would copy all of it for each.
    """
    return F.when(start + 1 == end, F.array(F.get(rows, start))).when(start < end, F.transform(F.sequence(start, end - 1), lambda i: F.get(rows, i)))
